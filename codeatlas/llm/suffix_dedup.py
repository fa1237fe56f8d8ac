"""Repeated byte strings over all documents, by external induced suffix sorting of shards.

A byte goes if a string of ``SPAN`` bytes that covers it also starts anywhere else. Such a
string is called a window here.

Sharding. Every window has an anchor: the string of ``ANCHOR`` bytes inside it with the least hash,
the leftmost of several. Equal windows have equal anchors, so they meet in the shard of their
anchor's hash. Neighbouring windows with the same anchor form one segment; what travels first are
hashes and places of segments, not their bytes. Segments whose anchor occurs once hold no repeated
window. Equal segments are counted as one, which takes large groups of copies together before anything
is sorted; all their windows are repeated. Left are different segments under one anchor: their
bytes are dealt to shards by anchor, and each shard's suffixes are sorted by
:mod:`codeatlas.llm.induced`, which spills to disk. A window is repeated if its suffix shares ``SPAN``
bytes with a neighbour. From the anchor on, bytes are sorted in blocks, as windows start before it.

Hot anchors, with more than ``HOT`` different segments (beginnings and ends of a passage that very many
documents share), aren't handed to one task: their segments are texts to which all this is done once
more with longer anchors, which hold some of what stands beside the passage. Windows of anchors that are hot
even then, which reach a few bytes beyond the passage, are counted by 128-bit digests of BLAKE2b.

Hashes of anchors only choose candidates; segments are equal when anchor hash and BLAKE2b digest
(64 bits each) are.

Edge cases: null and empty texts have no bytes, like texts shorter than a window no repeated ones;
rows with null or repeated ``doc_id`` are told apart by a row number; the text of a repeated row is
repeated wherever it is long enough; texts are read whole; an empty table gives an empty one; columns
other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeatlas.llm.common import drop_path, mapped, release, shared_dir, shuffle_partitions, stored
from codeatlas.llm.induced import HELD, Alphabet, DiskSort, Tape, repeated

SPAN = 200
#: Bytes of an anchor, of the longer anchors for hot ones, and of those that tell which windows of a shard can be equal.
ANCHOR, FINER, FINEST = 64, 160, 192
#: Bytes of a block behind the place where windows of an anchor begin last.
BLOCK = 64
#: Different segments of an anchor from which its windows are counted one by one.
HOT = 512
#: Bytes of segments in a shard, and of texts in a bucket.
SHARD_BYTES, BUCKET_BYTES = 4 << 20, 64 << 20
#: Windows looked at together: their hashes fit a processor's cache.
_CHUNK = 1 << 17
_PLACE = np.uint64((1 << 21) - 1)

SEGMENTS = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("size", T.IntegerType()),
        T.StructField("lead", T.IntegerType()),
        T.StructField("anchor", T.LongType()),
        T.StructField("digest", T.LongType()),
    ]
)
SPANS = T.StructType([T.StructField("row", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes (a multiple of 32) in ``data``."""
    hashes = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,)).copy()
    width, unit = 8, 8
    while width < size:
        # Double the width where that fits, and add a unit of 32 bytes elsewhere.
        part = hashes if 2 * width <= size else unit
        step = width
        mixed = hashes[: len(part) - step] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += part[step:]
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        width += width if part is hashes else 32
        hashes = mixed
        if width == 32:
            unit = hashes
    return hashes


def least_places(hashes: np.ndarray, count: int) -> np.ndarray:
    """Place of the leftmost least of each ``count`` neighbouring hashes (compared by their upper 43 bits)."""
    found = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= count:
        found = np.minimum(found[:-width], found[width:])
        width *= 2
    if width < count:
        found = np.minimum(found[: len(found) - (count - width)], found[count - width :])
    return (found & _PLACE).astype(np.int64)


def segments_of(texts: list[bytes], size: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of the segments of ``texts``: text, start, size, bytes before the anchor, hash of the anchor, digest.

    Anchors have ``size`` bytes.
    """
    joined = b"".join(texts)
    whole, view, blake = np.frombuffer(joined, np.uint8), memoryview(joined), hashlib.blake2b
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    for at in range(0, len(whole) - SPAN + 1, _CHUNK):
        data = whole[at : at + _CHUNK + SPAN - 1]
        hashes = grams(data, size)
        anchors = least_places(hashes, SPAN - size + 1)
        places = np.arange(at, at + len(anchors))
        owner = np.searchsorted(ends, places, side="right")
        inside = ends[owner] - places >= SPAN
        change = np.ones(len(anchors), bool)
        change[1:] = (anchors[1:] != anchors[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(change & inside)
        # A segment ends where the next one begins or where windows leave the text.
        stop = np.append(np.flatnonzero(change), len(anchors))
        stop = np.minimum(stop[np.searchsorted(stop, first, side="right")], ends[owner[first]] - SPAN + 1 - at)
        own = owner[first]
        begin = first + at - (ends[own] - sizes[own])
        digests = b"".join([blake(view[a:b], digest_size=8).digest() for a, b in zip((first + at).tolist(), (stop + at + SPAN - 1).tolist(), strict=True)])
        yield own, begin, stop - first + SPAN - 1, anchors[first] - first, hashes[anchors[first]].view(np.int64), np.frombuffer(digests, "<i8")


def segment_table(numbered: DataFrame, size: int = ANCHOR) -> DataFrame:
    """Hashes and places of all segments of ``numbered`` (``row, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            rows = batch["row"].to_numpy(zero_copy_only=False)
            for own, *columns in segments_of([t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()], size):
                held = [rows[own], *columns]
                yield {f.name: pa.array(c, f.type) for f, c in zip(to_arrow_schema(SEGMENTS), held, strict=True)}

    return mapped(numbered.select("row", "text"), run, SEGMENTS)


# -- shards -------------------------------------------------------------------


def _finer_keys(texts: list[bytes], anchors: list[int]) -> Iterator[np.ndarray]:
    """For each text a key of each of its windows; equal windows of segments with equal anchors have equal keys."""
    whole = np.frombuffer(b"".join(texts), np.uint8)
    hashes = grams(whole, FINEST)
    keys = hashes[least_places(hashes, SPAN - FINEST + 1)]
    at = 0
    for text, anchor in zip(texts, anchors, strict=True):
        yield keys[at : at + len(text) - SPAN + 1] ^ np.uint64(anchor & (2**64 - 1))
        at += len(text)


def repeated_in_shard(strings: Iterator[list[tuple[int, int, int, int, bool, bytes]]], held: int = HELD) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of runs of repeated windows in the lone segments of a shard.

    ``strings`` come in small lists: (row, start, bytes before the anchor, hash of the anchor, lone, bytes).
    """
    kept, keys, wanted = Tape(held), [], []
    for some in strings:
        found, asked = [], set()
        for item, own in zip(some, _finer_keys([s[5] for s in some], [s[3] for s in some]), strict=True):
            mine = set(own.tolist())
            found += mine
            if item[4]:
                asked |= mine
            kept.add((*item, own.tobytes()))
        kept.trim()
        keys.append(np.array(found, np.uint64))
        wanted.append(np.array(list(asked), np.uint64))
    values, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_counts=True)
    shared = np.intersect1d(values[counts > 1], np.concatenate(wanted)) if wanted else values
    if not len(shared):
        return

    # Only windows whose key another segment has can be repeated, and only those of lone segments are asked
    # for: segments are cut to these. Behind the last
    # place where one begins, counted from the anchor, the segments of an anchor are aligned, and cut into blocks.
    near, least_gap = Tape(held), {}
    for row, start, lead, anchor, lone, data, own in kept.forwards():
        own = np.frombuffer(own, np.uint64)
        hit = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own)
        if len(hit):
            low, last = int(hit[0]), int(hit[-1])
            near.add((row, start + low, lead - low, anchor, lone, data[low : last + SPAN]))
            near.trim()
            least_gap[anchor] = min(least_gap.get(anchor, SPAN), lead - last)
    pieces, blocks = Tape(held), DiskSort(held)
    places = array("q")
    at, nth = 0, 0
    for row, start, lead, anchor, lone, data in near.forwards():
        # A window begins before this place at the latest one further on.
        cut = max(0, lead - least_gap[anchor] + 1)
        head, tail = data[:cut], data[cut:]
        cuts = [tail[i : i + BLOCK] for i in range(0, len(tail), BLOCK)]
        for i, block in enumerate(cuts):
            blocks.add((block, nth, i))
        pieces.add((row, start, lone, head))
        places.append(at)
        at += len(head) + len(cuts) + 1
        nth += 1
        pieces.trim()
        blocks.trim()
    if nth < 2:
        return
    # Symbols: an end mark for each piece, the last one the smallest; bytes; blocks in their order.
    weights, common = [0] * nth + [1] * 256, [0] * (nth + 256)
    before, named = None, DiskSort(held)
    for block, piece, i in blocks.ordered():
        if block != before:
            n = 0
            if before is not None:
                while n < min(len(block), len(before)) and block[n] == before[n]:
                    n += 1
            weights.append(len(block))
            common.append(n)
            before = block
        named.add((piece, i, len(weights) - 1))
        named.trim()
    spelled, ranges = Tape(held), Tape(held)
    for row, start, lone, head in pieces.forwards():
        spelled.add(head)
        ranges.add((row, start, lone))
        spelled.trim()
        ranges.trim()

    def symbols() -> Iterator[int]:
        names = named.ordered()
        name = next(names, None)
        for piece, head in enumerate(spelled.forwards()):
            for byte in head:
                yield nth + byte
            while name is not None and name[0] == piece:
                yield name[2]
                name = next(names, None)
            yield piece + 1 if piece < nth - 1 else 0

    marks = DiskSort(held)
    for place in repeated(symbols(), Alphabet(weights, common, SPAN), held):
        piece = bisect_right(places, place) - 1
        marks.add((piece, place - places[piece]))
        marks.trim()
    mark = marks.ordered()
    now = next(mark, None)
    for piece, (row, start, lone) in enumerate(ranges.forwards()):
        first = last = None
        while now is not None and now[0] == piece:
            offset = now[1]
            if last is not None and offset > last + 1:
                if lone:
                    yield row, start + first, start + last + SPAN
                first = None
            if first is None:
                first = offset
            last = offset
            now = next(mark, None)
        if lone and last is not None:
            yield row, start + first, start + last + SPAN


STRINGS = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("lead", T.IntegerType()),
        T.StructField("anchor", T.LongType()),
        T.StructField("lone", T.BooleanType()),
        T.StructField("hot", T.BooleanType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def _strings(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of the segments in column ``wanted`` of ``asked``, one row for each row of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for row, text, wanted in zip(batch["row"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["wanted"].to_pylist(), strict=True):
                for w in wanted:
                    out.append((row, w["start"], w["lead"], w["anchor"], w["lone"], w["hot"], text[w["start"] : w["start"] + w["size"]]))
                if len(out) > 10_000:
                    yield out
                    out = []
            yield out

    return mapped(texts.join(asked, "row").select("row", "text", "wanted"), run, STRINGS)


def _sorted_shards(strings: DataFrame, shards: int, held: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        lists = (list(zip(*(b[c].to_pylist() for c in ("row", "start", "lead", "anchor", "lone", "data")), strict=True)) for b in batches)
        # Millions of small tuples without cycles: the collector would only walk over them.
        enabled = gc.isenabled()
        gc.disable()
        try:
            out = []
            for span in repeated_in_shard(lists, held):
                out.append(span)
                if len(out) == 10_000:
                    yield out
                    out = []
            yield out
        finally:
            if enabled:
                gc.enable()

    return mapped(strings.repartition(shards, "anchor"), run, SPANS)


WINDOWS = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("lone", T.BooleanType()),
        T.StructField("high", T.LongType()),
        T.StructField("low", T.LongType()),
    ]
)


def _counted_windows(strings: DataFrame) -> DataFrame:
    """Repeated windows of lone segments, by the digest of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        digest = hashlib.blake2b
        for batch in batches:
            out = []
            for row, start, lone, data in zip(*(batch[c].to_pylist() for c in ("row", "start", "lone", "data")), strict=True):
                for i in range(len(data) - SPAN + 1):
                    sign = digest(data[i : i + SPAN], digest_size=16).digest()
                    out.append((row, start + i, lone, int.from_bytes(sign[:8], "little", signed=True), int.from_bytes(sign[8:], "little", signed=True)))
                if len(out) > 20_000:
                    yield out
                    out = []
            yield out

    windows, _ = stored(mapped(strings, run, WINDOWS), "windows")
    often, _ = stored(windows.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "often")
    return windows.where("lone").join(often, ["high", "low"], "left_semi").select("row", "start", (F.col("start") + SPAN).alias("end"))


# -- the operator -------------------------------------------------------------


@contextlib.contextmanager
def numbered_texts(docs: DataFrame) -> Iterator[DataFrame]:
    """``row, doc_id, text`` as a table in buckets of ``row``, which later joins don't shuffle again."""
    spark = docs.sparkSession
    plain, plain_path = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")
    total = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))
    path = shared_dir(spark, "texts")
    name = "texts_" + path.rpartition("-")[2]
    dealt = plain.repartition(buckets, "row")
    dealt.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "row").sortBy("row").saveAsTable(name)
    drop_path(spark, plain_path)
    release(spark)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_spans(texts: DataFrame, held: int = HELD, hot: int = HOT, size: int = ANCHOR) -> DataFrame:
    """``row, start, end`` of bytes to remove in ``texts`` (``row, text``); spans of a row may overlap.

    ``size`` is that of the anchors; hot ones are taken up again with ``FINER`` bytes.
    """
    spark = texts.sparkSession
    table, table_path = stored(segment_table(texts, size), "segments")
    # Tables that others join by a key are read from storage, so that Spark may split a hot key's rows.
    often, often_path = stored(table.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "often")
    met, met_path = stored(table.join(often, "anchor", "left_semi").withColumn("place", F.xxhash64("row", "start")), "met")
    drop_path(spark, table_path)
    release(spark)
    classes, class_path = stored(met.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min("place").alias("one")), "classes")
    groups = classes.groupBy("anchor").agg(F.count("*").alias("kinds"), F.count_if(F.col("n") == 1).alias("lone"))
    groups, group_path = stored(groups.where("kinds > 1 or lone = 0"), "groups")
    labels, label_path = stored(classes.join(groups, "anchor"), "labels")
    joined = met.join(labels, ["anchor", "digest"])
    known, known_path = stored(joined.select("row", "start", "size", "lead", "anchor", "n", "kinds", "lone", (F.col("place") == F.col("one")).alias("first")), "known")
    for path in (often_path, met_path, class_path, group_path, label_path):
        drop_path(spark, path)
    release(spark)

    whole = known.where("n > 1").select("row", "start", (F.col("start") + F.col("size")).alias("end"))
    needed = known.where("kinds > 1 and lone > 0 and first")
    shards = max(shuffle_partitions(spark), -(-(needed.agg(F.sum("size")).first()[0] or 0) // SHARD_BYTES))
    wanted = needed.groupBy("row").agg(F.collect_list(F.struct("start", "size", "lead", "anchor", (F.col("n") == 1).alias("lone"), (F.col("kinds") > hot).alias("hot"))).alias("wanted"))
    strings, string_path = stored(_strings(wanted, texts), "strings")
    release(spark)
    cold, _ = stored(_sorted_shards(strings.where("not hot"), shards, held), "cold")
    spans = whole.unionByName(cold)
    if not strings.where("hot").isEmpty():
        if size < FINER:
            parts, _ = stored(strings.where("hot").withColumn("part", F.monotonically_increasing_id()), "parts")
            finer = repeated_spans(parts.select(F.col("part").alias("row"), F.col("data").alias("text")), held, hot, FINER)
            lone = parts.where("lone").select("part", F.col("row").alias("own"), F.col("start").alias("at"))
            warm = finer.withColumnRenamed("row", "part").join(lone, "part").select(F.col("own").alias("row"), (F.col("start") + F.col("at")).alias("start"), (F.col("end") + F.col("at")).alias("end"))
        else:
            warm = _counted_windows(strings.where("hot"))
        spans = spans.unionByName(warm)
    spans, _ = stored(spans, "spans")
    for path in (string_path, known_path):
        drop_path(spark, path)
    release(spark)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


REMOVED = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def without_repeats(docs: DataFrame, held: int = HELD, hot: int = HOT) -> DataFrame:
    """``row, doc_id, n_bytes, spans, kept`` of each row of ``docs``: what goes, in byte offsets, and the bytes that stay.

    ``kept`` need not be valid UTF-8, as a repeated string may begin inside a character.
    """
    with numbered_texts(docs) as texts:
        spans = repeated_spans(texts, held, hot)
        by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
            for batch in batches:
                out = []
                for row, doc, text, found in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), batch["spans"].to_pylist(), strict=True):
                    text, gone = text or b"", merged([(s["start"], s["end"]) for s in found or ()])
                    kept, at = [], 0
                    for start, end in gone:
                        kept.append(text[at:start])
                        at = end
                    kept.append(text[at:])
                    out.append((row, doc, len(text), [{"start": s, "end": e} for s, e in gone], b"".join(kept)))
                yield out

        made = mapped(texts.join(by_row, "row", "left").select("row", "doc_id", "text", "spans"), run, REMOVED)
        return stored(made, "removed")[0]


def removal_digests(removed: DataFrame) -> DataFrame:
    """Counts and digests of :func:`without_repeats`."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
