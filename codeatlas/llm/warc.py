"""Web archives: writing, an index merged from sorted runs, and reading back.

Each task writes gzip-per-record archives of bounded size and, beside each, a run of index
entries sorted by URL key, timestamp and page. The runs are dealt out by range of that key;
each range merges its pieces of the runs with a loser tree, which gives one globally ordered
history of captures for every URL. Records are read back at the places the index names.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the largest
``page_id`` carries the payload, and the others are revisits of it.

A revisit is resolved by the page it refers to and by its own payload digest, so pages that share
a ``page_id`` but not a payload are told apart. Archives carry their task attempt in their name and
the index names them, so an attempt that was given up or comes late changes no file that is read.

Edge cases: a null html is an empty payload, a null url an empty one; rows with a null
``page_id`` get records of their own and never carry a payload that others revisit; repeated
rows give repeated records, and all rows with the largest ``page_id`` of a payload are responses;
an empty table gives no archive; a record is held in memory as a whole, however long; columns
other than ``page_id``, ``url`` and ``html`` are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import drop_path, mapped, qualified, shared_dir, shuffle_partitions, stored
from codeatlas.llm.storage import created, opened

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
RUN_ROWS = 20_000
MERGE_ROWS = 100_000
MERGED_AT_ONCE = 5000
FIRST_DATE = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ID = "urn:capture:page:"


# -- records ------------------------------------------------------------------


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels in reverse, then port, path and query, lower-cased."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")).lower()


def capture_time(page_id: int | None) -> str:
    """A date for a table that has none: seconds after the first date, by page."""
    return (FIRST_DATE + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None) -> str:
    return f"<{_ID}{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    value = (record or "").strip("<>").removeprefix(_ID)
    return int(value) if value.lstrip("-").isdigit() else None


def base32_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member holding a response, or a revisit of page ``refers_to``."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: {base32_digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    block = HTTP_HEAD
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def read_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and payload of a record; digests are tested."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size + 4 or rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("the record is cut off")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and base32_digest(payload) != fields["warc-payload-digest"]:
        raise ValueError("the payload's digest is wrong")
    return fields, payload


# -- runs and their merge -----------------------------------------------------


class LoserTree:
    """Merge of k sorted iterators: each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key = runs, key
        k = self.size = max(1, len(runs))
        self.heads = [self._next(i) if i < len(runs) else None for i in range(k)]
        self.nodes = [-1] * k
        for i in range(k):
            self._climb(i, building=True)

    def _next(self, i: int) -> tuple | None:
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] <= y[:2])

    def _climb(self, i: int, building: bool = False) -> None:
        winner, node = i, (i + self.size) // 2
        while node > 0:
            held = self.nodes[node]
            if building and held < 0:
                self.nodes[node] = winner
                return
            if not self._beats(winner, held):
                self.nodes[node], winner = winner, held
            node //= 2
        self.nodes[0] = winner

    def __iter__(self) -> Iterator:
        while (top := self.heads[self.nodes[0]]) is not None:
            yield top[2]
            i = self.nodes[0]
            self.heads[i] = self._next(i)
            self._climb(i)


INDEX = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)
_ORDER = ("url_key", "timestamp", "page_id", "file", "offset")


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``refers_to``: the page that carries an equal payload, or null."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    long = rows.where(F.octet_length("html") >= LEAST_REVISIT)
    # Read from storage, so that the join may split the rows of one payload.
    carriers, _ = stored(
        long.groupBy("digest").agg(F.max("page_id").alias("carrier"), F.count("*").alias("n")).where("n > 1 and carrier is not null").select("digest", "carrier"), "carriers"
    )
    revisit = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("carrier")), F.col("carrier"))
    return rows.join(carriers, "digest", "left").select("page_id", "url", "html", revisit.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives below ``folder``; the entries of their sorted runs, in the columns of :data:`INDEX`."""
    folder = qualified(pages.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True))
        row, n = next(rows, None), 0
        while row is not None:
            name, entries, at = f"{folder}/part-{part:06d}-{n:04d}-{attempt}.warc.gz", [], 0
            with created(name) as file:
                while row is not None and at < ARCHIVE_BYTES and len(entries) < RUN_ROWS:
                    page, url, html, target = row
                    member = write_record(page, url, html.encode(), target)
                    file.write(member)
                    entries.append((url_key(url), capture_time(page), page, name, at, len(member)))
                    at += len(member)
                    row = next(rows, None)
            entries.sort(key=_sort_key)
            yield [(*e, i) for i, e in enumerate(entries)]
            n += 1

    return mapped(with_revisits(pages), run, INDEX)


def _sort_key(entry: tuple) -> tuple:
    key, time, page, file, offset = entry[:5]
    return key, time, page is not None, page or 0, file, offset


def merge_runs(runs: DataFrame) -> DataFrame:
    """All runs as one ordered history: ``position`` counts captures from 0 over the whole index."""
    spark = runs.sparkSession
    total = runs.count()
    ranges = max(shuffle_partitions(spark), -(-total // MERGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for entry in zip(*(batch[name].to_pylist() for name in INDEX.names), strict=True):
                pieces.setdefault(entry[3], []).append(entry)
        tree = LoserTree([iter(p) for _, p in sorted(pieces.items())], _sort_key)
        part, out = TaskContext.get().partitionId(), []
        for nth, entry in enumerate(tree):
            out.append((*entry, part, nth))
            if len(out) == MERGED_AT_ONCE:
                yield out
                out = []
        yield out

    dealt = runs.repartitionByRange(ranges, *_ORDER).sortWithinPartitions("file", "seq")
    schema = T.StructType([*INDEX.fields, T.StructField("range", T.LongType()), T.StructField("nth", T.LongType())])
    merged, _ = stored(mapped(dealt, merge, schema), "index")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range: as many as partitions.
    starts = merged.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return merged.join(F.broadcast(starts), "range").withColumn("position", F.col("start") + F.col("nth")).drop("range", "start", "nth", "seq")


READ = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url_key", T.StringType()),
        T.StructField("position", T.LongType()),
    ]
)


def read_archives(index: DataFrame) -> DataFrame:
    """Records at the places of ``index``; a revisit has size and digest of the payload it refers to."""
    spark = index.sparkSession
    columns = ("file", "offset", "length", "url_key", "position")
    dealt = index.repartition(max(8, shuffle_partitions(spark)), "file").sortWithinPartitions("file", "offset").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        name, file = None, None
        for batch in batches:
            rows = []
            for at, offset, length, key, position in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if at != name:
                    if file is not None:
                        file.close()
                    name, file = at, opened(at)
                file.seek(offset)
                fields, payload = read_record(file.read(length))
                kind = fields["warc-type"]
                own = kind == "response"
                # A response's digest was tested against its payload; a revisit's is that of the payload it stands for.
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                rows.append((page_of(fields["warc-record-id"]), len(payload) if own else None, digest, kind, page_of(fields.get("warc-refers-to")), key, position))
            yield rows
        if file is not None:
            file.close()

    held, _ = stored(mapped(dealt, run, READ), "records")
    targets = held.where("record_type = 'revisit'").select(F.col("refers_to").alias("carrier"), F.col("payload_digest").alias("wanted")).distinct()
    responses = held.where("record_type = 'response'").select(F.col("page_id").alias("carrier"), F.col("payload_digest").alias("wanted"), F.col("payload_bytes").alias("full_bytes"))
    carriers, _ = stored(responses.join(targets, ["carrier", "wanted"], "left_semi").distinct(), "carriers")
    found = held.join(carriers, (F.col("refers_to") == F.col("carrier")) & (F.col("payload_digest") == F.col("wanted")), "left")
    return found.withColumn("payload_bytes", F.coalesce("payload_bytes", "full_bytes")).select(*READ.names)


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (``page_id, url, html``), merge the index, and read all records back."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    runs, path = stored(write_archives(pages, folder), "runs")
    index = merge_runs(runs)
    drop_path(spark, path)
    return read_archives(index)
