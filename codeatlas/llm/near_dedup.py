"""Near-duplicate groups by a multi-index Hamming join over MinHash signatures.

A signature has ``CHUNKS * SYMBOLS`` symbols of 16 bits, and two texts of similarity J agree in
each symbol with a chance of J. It is split into chunks. By the pigeonhole principle two
signatures that differ in fewer than ``CHUNKS * (ERRORS + 1)`` symbols have a chunk with at
most ``ERRORS`` differing symbols; enumerating the places of that error gives keys that are
equal for such chunks. Every pair within that distance therefore meets under a key, and so
do nearly all beyond it: at similarity 0.75 a pair is missed with a chance of one in a million.

Buckets never emit all their pairs. First every member is linked to its bucket's smallest
member, its leader. After full-set checks and components of those links, only buckets that
still hold more than one component go on. The rows of a bucket's largest component are its base,
the others are open. Star rounds link each open row to one base member, another one in each round,
as long as a tenth of the tried pairs turn out to be links. Of what is left only pairs across
components are looked at: signatures first, which gives clusters, then the full sets within a
cluster. Base rows aren't compared with each other: blocks of open rows meet blocks of the base and
each other, two at a time, so that a row is copied as often as there are blocks of open rows.
Texts with the same shingle set are one class, which enters with its smallest ``doc_id``.

Edge cases: null, empty and blank texts have no shingles and link with nothing; fewer words
than a shingle are one unit; rows with a null ``doc_id`` are their own row with a null component
(and a null ``kept``); rows that share a ``doc_id`` are one node, which has the links of all of them;
texts are read whole, a class of very long ones being compared as sorted hashes; an empty table
gives an empty one; columns other than ``doc_id`` and ``text`` are not read by :func:`near_dedup`,
and handed on as they are by :func:`keep_first`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import drop_path, fresh, mapped, release, shuffle_partitions, small_batches, stored
from codeatlas.llm.components import connected_components

WIDTH = 5
PERCENT = 75
CHUNKS, SYMBOLS, ERRORS = 18, 6, 1
#: Largest distance that a candidate pair may have before its full sets are compared; at
#: similarity 0.75 a pair lies beyond it with a chance below one in a million.
FARTHEST = 51
#: Rows of a block; a task compares two blocks, by signatures under a key and by texts in a cluster.
KEY_BLOCK, TEXT_BLOCK = 1024, 256
#: Members that share one copy of their leader's text when full sets are compared.
SHARE = 128
WORDS = 150_000

_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(1, 2**63, size=CHUNKS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """64-bit hash of each word; emptied when full."""

    def __init__(self, limit: int = WORDS):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


_HASHES = _WordHashes()


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII blanks split
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    size = min(n, width)
    total = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total += hashes[i : n - size + 1 + i] * _PLACES[i]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """16-bit MinHash symbols of a non-empty set."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at : at + 1024, None] * _FACTORS).min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys (rows, CHUNKS * SYMBOLS): each chunk with each one of its symbols left out."""
    rows = len(signatures)
    parts = signatures.reshape(rows, CHUNKS, SYMBOLS).astype(np.uint64) + np.uint64(1)
    weighed = parts * _PLACES[:SYMBOLS]
    whole = weighed.sum(axis=2, dtype=np.uint64)
    keys = whole[:, :, None] - weighed
    salt = (np.arange(CHUNKS * SYMBOLS, dtype=np.uint64) + np.uint64(1)) * _PLACES[SYMBOLS]
    return _mixed(keys.reshape(rows, -1) + salt).view(np.int64)


SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_hash", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
    ]
)


def sketches(docs: DataFrame) -> DataFrame:
    """Size, 128-bit hash and signature of each row's shingle set; null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                held = shingle_set(text)
                if len(held):
                    rows.append((doc, len(held), xxhash.xxh3_128_digest(held.tobytes()), signature(held).tobytes()))
                else:
                    rows.append((doc, 0, None, None))
            yield rows

    return mapped(docs.select("doc_id", "text"), run, SKETCH)


def keyed(classes: DataFrame) -> DataFrame:
    """``key, id, n``: a row for each class and each key of its signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                found = np.frombuffer(b"".join(part["signature"]), dtype=np.uint16).reshape(len(part), -1)
                keys = chunk_keys(found)
                times = keys.shape[1]
                yield pd.DataFrame({"key": keys.ravel(), "id": np.repeat(part["id"].to_numpy(), times), "n": np.repeat(part["n"].to_numpy(), times)})

    return classes.select("id", "n", "signature").mapInPandas(run, "key long, id long, n long")


def near_size(a: str, b: str) -> str:
    """Sizes that allow the similarity."""
    return f"least({a}, {b}) * 100 >= greatest({a}, {b}) * {PERCENT}"


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those ``pairs`` (``u`` < ``v``) whose full shingle sets reach the similarity, as ``u, v``.

    Members are dealt out with copies of their leader's text, so many of them to a copy, and
    stream past its set; no group is held in memory.
    """
    spark = pairs.sparkSession
    small_batches(spark)
    # Counts are read from storage, so that joins with them may split a large group.
    sizes, _ = stored(pairs.groupBy("u").agg(F.ceil(F.count("*") / SHARE).alias("copies")), "sizes")
    members = pairs.join(sizes, "u").select("u", F.pmod(F.xxhash64("v"), F.col("copies")).alias("copy"), F.col("v").alias("doc_id"), F.lit(1).alias("role"))
    leaders = sizes.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("u").alias("doc_id"), F.lit(0).alias("role"))
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    dealt = (
        texts.join(members.unionByName(leaders).hint("merge"), "doc_id")  # grows with the data: not for broadcasting
        .repartition(max(8, shuffle_partitions(spark)), "u", "copy")
        .sortWithinPartitions("u", "copy", "role", "doc_id")
        .select("u", "copy", "role", "doc_id", "text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leader, held = None, np.empty(0, dtype=np.uint64)
        for batch in batches:
            links = []
            for u, _, role, doc, text in batch.itertuples(index=False):
                if role == 0:
                    leader, held = u, shingle_set(text)
                    continue
                assert leader == u, "the leader comes first"
                own = shingle_set(text)
                both = len(np.intersect1d(held, own, assume_unique=True))
                if both and 100 * both >= PERCENT * (len(held) + len(own) - both):
                    links.append((u, doc))
            yield pd.DataFrame(links, columns=["u", "v"], dtype=np.int64)

    return dealt.mapInPandas(run, "u long, v long").distinct()


def blocks(rows: DataFrame, group: str, size: int, counted: DataFrame | None = None) -> DataFrame:
    """Deal the rows of each group into pairs of blocks: any two of different components meet, and no task holds a large group.

    The largest component (column ``part``) of a group is its base; its blocks come first and
    meet only those of the other rows. Adds ``p <= q`` and ``mine``, the row's own block.
    ``counted`` has the same groups and components in fewer columns, for counting.
    """
    spark = rows.sparkSession
    parts = (rows if counted is None else counted).groupBy(group, "part").agg(F.count("*").alias("n"))
    blocks_of = lambda n: F.ceil(n / size).cast("int")
    counts, _ = stored(
        parts.groupBy(group)
        .agg(F.max(F.struct("n", "part")).alias("base"), F.sum("n").alias("n"))
        .select(group, F.col("base.part").alias("base"), blocks_of(F.col("base.n")).alias("in_base"), blocks_of(F.col("n") - F.col("base.n")).alias("in_open")),
        "blocks",
    )
    placed = rows.join(counts, group).withColumn("is_base", F.col("part") == F.col("base"))
    hashed = F.xxhash64("id")
    mine = F.when(F.col("is_base"), F.pmod(hashed, F.col("in_base"))).otherwise(F.col("in_base") + F.pmod(hashed, F.greatest("in_open", F.lit(1)))).cast("int")
    first = F.when(F.col("is_base"), F.col("in_base")).otherwise(0)
    last = F.col("in_base") + F.col("in_open") - 1
    # A group of one component has no open rows and no pairs.
    both = placed.where("in_open > 0").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(first, last)))
    paired = both.withColumns({"p": F.least("mine", "other"), "q": F.greatest("mine", "other")}).drop("other", "base", "in_base", "in_open", "is_base")
    return paired.repartition(max(8, shuffle_partitions(spark)), group, "p", "q").sortWithinPartitions(group, "p", "q", "id")


def each_group(batches: Iterator[pd.DataFrame], group: str) -> Iterator[dict[str, np.ndarray]]:
    """The columns of one ``(group, p, q)`` at a time, from a sorted stream; groups of one row are left out."""
    held: list[dict[str, np.ndarray]] = []
    last = None

    def whole() -> dict[str, np.ndarray]:
        return held[0] if len(held) == 1 else {c: np.concatenate([x[c] for x in held]) for c in held[0]}

    for batch in batches:
        if not len(batch):
            continue
        columns = {c: batch[c].to_numpy() for c in batch.columns}
        marks = np.stack([columns[group], columns["p"], columns["q"]])
        cuts = (np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            mark = tuple(marks[:, lo].tolist())
            if held and mark != last:
                if len(held) > 1 or len(held[0]["id"]) > 1:
                    yield whole()
                held = []
            last = mark
            held.append({c: x[lo:hi] for c, x in columns.items()})
    if held and (len(held) > 1 or len(held[0]["id"]) > 1):
        yield whole()


def in_frames(edges: Iterator[list[tuple[int, int]]], size: int = 5000) -> Iterator[pd.DataFrame]:
    """Edges of many groups in few frames."""
    held: list[tuple[int, int]] = []
    for more in edges:
        held += more
        if len(held) >= size:
            yield pd.DataFrame(held, columns=["u", "v"], dtype=np.int64)
            held = []
    yield pd.DataFrame(held, columns=["u", "v"], dtype=np.int64)


def stars_of(ids: np.ndarray, edges: list[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Components of ``edges`` (a place, and the places it is linked to) as (smallest id, other id)."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, linked in edges:
        for j in linked.tolist():
            a, b = find(i), find(j)
            if a != b:
                low, high = (a, b) if ids[a] < ids[b] else (b, a)
                root[high] = low
    return [(int(ids[find(i)]), int(ids[i])) for i in range(len(ids)) if find(i) != i]


def open_pairs(rows: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row the later rows of its group that may be linked to it.

    They lie in the other block (or in the one block), in another component, have a fitting
    size and a close signature.
    """
    part, n, mine = rows["part"], rows["n"], rows["mine"]
    found = np.frombuffer(b"".join(rows["signature"].tolist()), dtype=np.uint16).reshape(len(part), -1)
    two = rows["p"][0] != rows["q"][0]
    for i in range(len(part) - 1):
        later = slice(i + 1, None)
        may = part[later] != part[i]
        if two:
            may &= mine[later] != mine[i]
        small, large = np.minimum(n[later], n[i]), np.maximum(n[later], n[i])
        may &= small * 100 >= large * PERCENT
        at = np.flatnonzero(may) + i + 1
        if len(at):
            at = at[(found[at] != found[i]).sum(axis=1) <= FARTHEST]
            if len(at):
                yield i, at


def close_clusters(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``id, cluster``: rows that share a key, lie in different components and have close signatures meet in a cluster.

    ``rows``: ``key, id, n, part``. Tasks hand on stars, never all pairs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_frames(stars_of(group["id"], list(open_pairs(group))) for group in each_group(batches, "key"))

    signed, signed_path = stored(rows.join(classes.select("id", "signature"), "id"), "signed")
    edges, path = stored(blocks(signed, "key", KEY_BLOCK).mapInPandas(run, "u long, v long"), "close")
    found = connected_components(edges).withColumnRenamed("component", "cluster")
    for used in (path, signed_path):
        drop_path(rows.sparkSession, used)
    return found


def links_across(clusters: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components of a cluster, ``u, v``, confirmed on full sets.

    A task has the texts of two blocks; intersections of one set with many are counted at once.
    """

    def linked(group: dict[str, np.ndarray]) -> list[tuple[int, int]]:
        sets = [shingle_set(x) for x in group["text"]]
        sizes = np.array([len(x) for x in sets])
        words, inverse = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        places = [inverse[e - k : e] for e, k in zip(ends, sizes, strict=True)]
        mark = np.zeros(len(words), dtype=np.int64)
        edges = []
        for i, at in open_pairs(group):
            mark[places[i]] = 1
            lengths = sizes[at]
            both = np.add.reduceat(mark[np.concatenate([places[j] for j in at])], np.cumsum(lengths) - lengths)
            mark[places[i]] = 0
            edges.append((i, at[100 * both >= PERCENT * (sizes[i] + lengths - both)]))
        return stars_of(group["id"], edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_frames(map(linked, each_group(batches, "cluster")))

    placed = clusters.join(parts, "id").join(classes.select("id", "n", "signature"), "id")
    rows, _ = stored(placed.select("cluster", "id", "part", "n", "signature"), "placed")
    texts = docs.select(F.col("doc_id").alias("id"), "text")
    return blocks(rows.hint("merge").join(texts, "id"), "cluster", TEXT_BLOCK, rows).mapInPandas(run, "u long, v long")


def near_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (``doc_id``, ``text``)."""
    spark = docs.sparkSession
    held, _ = stored(sketches(docs), "sketches")
    named = held.where("set_hash is not null and doc_id is not null")
    classes, _ = stored(
        named.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes"
    )
    keys, key_path = stored(keyed(classes), "keys")
    release(spark)

    leader = F.min(F.struct("id", "n")).alias("leader")
    buckets, bucket_path = stored(keys.groupBy("key").agg(leader, F.count("*").alias("members")).where("members > 1").select("key", "leader"), "buckets")
    shared, shared_path = stored(keys.join(buckets.hint("merge"), "key"), "shared")
    drop_path(spark, key_path)
    drop_path(spark, bucket_path)
    release(spark)
    stars, star_path = stored(
        shared.where("id != leader.id")
        .where(near_size("n", "leader.n"))
        .groupBy(F.col("leader.id").alias("u"), F.col("id").alias("v"))
        .agg(F.count("*").alias("met")),
        "stars",
    )
    # Each member with the leader that it met under most keys.
    best = stars.groupBy("v").agg(F.max(F.struct("met", (-F.col("u")).alias("u"))).alias("best")).select((-F.col("best.u")).alias("u"), "v")
    first, _ = stored(confirmed(best, docs), "links")
    release(spark)
    parts, _ = stored(connected_components(first), "components")

    # What is left: pairs under one key that are not in one component yet.
    part = parts.select("id", "component")
    placed = shared.select("key", "id", "n").join(part, "id", "left").select("key", "id", "n", F.coalesce("component", "id").alias("part"))
    open_rows, open_path = stored(_still_mixed(placed), "open")
    drop_path(spark, shared_path)
    open_rows, more = star_rounds(open_rows, docs)
    clusters, _ = stored(close_clusters(open_rows, classes), "clusters")
    held_parts, _ = stored(open_rows.select("id", "part").distinct(), "parts")
    drop_path(spark, open_path)
    drop_path(spark, star_path)
    release(spark)
    second, _ = stored(links_across(clusters, held_parts, classes, docs), "links")
    release(spark)
    links = reduce(DataFrame.unionByName, [first, *more, second])
    whole, _ = stored(connected_components(links), "components")
    reached = classes.join(whole, "id", "left").select("set_hash", F.coalesce("component", "id").alias("component"))
    return held.join(reached, "set_hash", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept")
    )


def _still_mixed(rows: DataFrame) -> DataFrame:
    """The rows (``key, id, n, part``) of buckets with more than one component."""
    mixed, _ = stored(rows.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least != most").select("key"), "mixed")
    return rows.join(mixed, "key", "left_semi")


def star_pairs(rows: DataFrame, number: int) -> DataFrame:
    """``u, v``: each open row with the base member, chosen by the round's ``number``, that it met under most keys."""
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id", F.lit(number)), "id", "n")).alias("lead"))
    bases, _ = stored(
        parts.groupBy("key").agg(F.max(F.struct("size", "part", "lead")).alias("base")).select("key", F.col("base.part").alias("base"), F.col("base.lead.id").alias("u"), F.col("base.lead.n").alias("u_n")), "bases"
    )
    met = rows.join(bases, "key").where("part != base").where(near_size("n", "u_n")).groupBy("u", F.col("id").alias("v")).agg(F.count("*").alias("met"))
    best = met.groupBy("v").agg(F.max(F.struct("met", (-F.col("u")).alias("u"))).alias("best"))
    return best.select((-F.col("best.u")).alias("u"), "v")


def star_rounds(rows: DataFrame, docs: DataFrame, number: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of buckets that are still mixed, and the links found, after star rounds with ever new leaders."""
    spark, links = rows.sparkSession, []
    while True:
        number += 1
        pairs, pair_path = stored(star_pairs(rows, number), "stars")
        tried = pairs.count()
        found, _ = stored(confirmed(pairs, docs), "links")
        drop_path(spark, pair_path)
        new = found.count()
        if new:
            links.append(found)
            held = rows.select("id", "part").distinct()
            ends = found.join(held.withColumnsRenamed({"id": "u", "part": "a"}), "u").join(held.withColumnsRenamed({"id": "v", "part": "b"}), "v")
            joined, _ = stored(connected_components(ends.select(F.col("a").alias("u"), F.col("b").alias("v"))), "joined")
            moved = rows.join(joined.select(F.col("id").alias("part"), "component"), "part", "left").select("key", "id", "n", F.coalesce("component", "part").alias("part"))
            rows, _ = stored(_still_mixed(moved), "open")
        release(spark)
        if new * 10 <= tried:
            return rows, links


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is its group's smallest, and rows without one."""
    name = fresh("dropped_id", docs)
    dropped = near_dedup(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, docs["doc_id"] == F.col(name), "left_anti")
