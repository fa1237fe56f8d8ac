"""Media columns: lossless PNG of bytes, read back with checksum tests, and a perceptual hash.

A payload fills an RGB image of 8-bit samples, 64 pixels wide. The writer picks for each row
the filter with the smallest sum of absolute differences; the reader tests every chunk's
checksum, inflates, and undoes the filters with numpy. The feature is a 64-bit hash of the
lowest frequencies of a cosine transform.

Edge cases: null and empty texts are one row of blanks; equal texts give equal bytes; repeated
rows, and rows with a null or repeated ``doc_id``, get an image each; an empty table gives an
empty one; an image is as high as its text needs; columns other than ``doc_id`` and ``text`` are
not read, whatever their names. A damaged image is a ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeatlas.llm.common import mapped

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

WIDTH = 64
ROW = WIDTH * 3
GRID = 32
LOW = 8


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text with blanks up to a positive multiple of a row, and its own size."""
    data = (text or "").encode()
    size = len(data)
    rows = max(1, -(-size // ROW))
    return data.ljust(rows * ROW, b" "), size


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(samples: np.ndarray, level: int = 6) -> bytes:
    """PNG of an array (height, width, channels) of 8-bit samples."""
    height, width, channels = samples.shape
    color = next(c for c, n in CHANNELS.items() if n == channels)
    rows = samples.reshape(height, width * channels)
    left = np.zeros_like(rows)
    left[:, channels:] = rows[:, :-channels]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    tried = np.stack([rows, rows - left, rows - above])
    cost = np.minimum(tried, 0 - tried).sum(axis=2, dtype=np.int64)
    kind = cost.argmin(axis=0)
    lines = np.empty((height, width * channels + 1), dtype=np.uint8)
    lines[:, 0] = kind
    lines[:, 1:] = tried[kind, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, color, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit, non-interlaced PNG; ``ValueError`` on any damage."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        (size,) = struct.unpack_from(">I", data, at)
        kind, content = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(content) != size or at + 12 + size > len(data):
            raise ValueError("a chunk is cut off")
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(content, zlib.crc32(kind)):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content)
        elif kind == b"IDAT":
            body.append(content)
        ended = kind == b"IEND"
        at += 12 + size
    if head is None or not ended:
        raise ValueError("a chunk is missing")
    width, height, depth, color, _, _, interlaced = head
    if depth != 8 or color not in CHANNELS or interlaced:
        raise ValueError("this kind of PNG isn't read")
    channels = CHANNELS[color]
    try:
        lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8)
    except zlib.error as error:
        raise ValueError("the image data are damaged") from error
    if lines.size != height * (width * channels + 1):
        raise ValueError("the image has another size")
    return unfilter(lines.reshape(height, -1), channels).reshape(height, width, channels)


def unfilter(lines: np.ndarray, channels: int) -> np.ndarray:
    """Undo the row filters; runs of rows with the same simple filter are done at once."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > 4:
        raise ValueError("an unknown filter")
    height, size = rows.shape
    borders = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), height]
    for lo, hi in zip(borders, borders[1:], strict=False):
        kind = kinds[lo] if lo < height else 0
        if kind == 1:
            rows[lo:hi] = np.cumsum(rows[lo:hi].reshape(hi - lo, -1, channels), axis=1, dtype=np.uint8).reshape(hi - lo, size)
        elif kind == 2:
            if lo:
                rows[lo] += rows[lo - 1]
            rows[lo:hi] = np.cumsum(rows[lo:hi], axis=0, dtype=np.uint8)
        elif kind > 2:
            for y in range(lo, hi):
                _unfilter_row(rows, y, channels, average=kind == 3)
    return rows


def _unfilter_row(rows: np.ndarray, y: int, channels: int, average: bool) -> None:
    above = rows[y - 1].astype(np.int64) if y else np.zeros(rows.shape[1], dtype=np.int64)
    row = rows[y].astype(np.int64)
    zero = np.zeros(channels, dtype=np.int64)
    for x in range(0, len(row), channels):
        a = row[x - channels : x] if x else zero
        b = above[x : x + channels]
        if average:
            guess = (a + b) // 2
        else:
            c = above[x - channels : x] if x else zero
            p = a + b - c
            da, db, dc = abs(p - a), abs(p - b), abs(p - c)
            guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
        row[x : x + channels] = (row[x : x + channels] + guess) % 256
    rows[y] = row


def _cosines() -> np.ndarray:
    n = np.arange(GRID)
    return np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(LOW)[:, None] / (2 * GRID))


_COSINES = _cosines()


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the lowest frequencies of a 32 x 32 grid of box means exceed their median."""
    grid = samples.mean(axis=2)
    for axis in (0, 1):
        size = grid.shape[axis]
        if size >= GRID:
            cuts = np.arange(GRID) * size // GRID
            widths = np.diff(np.append(cuts, size))
            grid = np.add.reduceat(grid, cuts, axis=axis) / (widths[:, None] if axis == 0 else widths)
        else:
            grid = grid.take(np.arange(GRID) * size // GRID, axis=axis)
    low = np.round(_COSINES @ grid @ _COSINES.T, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("media", T.BinaryType()),
    ]
)
READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
    ]
)


def to_media(docs: DataFrame) -> DataFrame:
    """Each text as a PNG in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            media, sizes = [], []
            for text in batch["text"].to_pylist():
                payload, size = payload_of(text)
                media.append(write_png(np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH, 3)))
                sizes.append(size)
            yield {"doc_id": batch["doc_id"], "n_bytes": sizes, "media": media}

    return mapped(docs.select("doc_id", "text"), run, STORED)


def media_digests(media: DataFrame) -> DataFrame:
    """Read the stored images back: their feature, and digests of payload and stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for doc, size, image in zip(*(batch[name].to_pylist() for name in STORED.names), strict=True):
                samples = read_png(image)
                payload = samples.tobytes()
                tail = zlib.crc32(payload[-16:])
                rows.append((doc, size, len(payload), hashlib.sha256(payload).hexdigest(), tail, len(image), hashlib.sha256(image).hexdigest(), cosine_hash(samples).hex()))
            yield rows

    return mapped(media.select(*STORED.names), run, READ)
