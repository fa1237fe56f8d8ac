"""Index maintenance: change detection, upserts, cascading deletes, missing vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETAILS = ("language", "size_bytes", "mtime_ms")


def compare_files(current: DataFrame, indexed: DataFrame, details: tuple[str, ...] = DETAILS) -> DataFrame:
    """Each path of either side with ``state``: added, removed, changed or same."""
    now = current.select("path", F.struct(*details).alias("now"))
    old = indexed.select("path", F.struct(*details).alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("old")), "same").otherwise("changed")
    return now.join(old, "path", "full_outer").select("path", state.alias("state"))


def pending_changes(current: DataFrame, indexed: DataFrame, details: tuple[str, ...] = DETAILS) -> DataFrame:
    """One row: ``added, changed, removed, freshness``."""
    states = compare_files(current, indexed, details)
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("added", "changed", "removed")]
    fresh = F.when(F.col("added") + F.col("changed") + F.col("removed") == 0, "fresh").otherwise("stale")
    return states.agg(*counts).withColumn("freshness", fresh)


def classify(current: DataFrame, indexed: DataFrame, details: tuple[str, ...] = DETAILS) -> DataFrame:
    """What to do with each path: insert, remove, skip, touch (same content) or update.

    ``sha1`` is compared only where the details differ.
    """
    now = current.select("path", F.struct(*details).alias("now"), F.col("sha1").alias("now_sha1"), F.lit(True).alias("here"))
    old = indexed.select("path", F.struct(*details).alias("old"), F.col("sha1").alias("old_sha1"), F.lit(True).alias("there"))
    both = now.join(old, "path", "full_outer")
    same_language = F.lit(True) if "language" not in details else F.col("now.language") == F.col("old.language")
    action = (
        F.when(F.col("there").isNull(), "insert")
        .when(F.col("here").isNull(), "remove")
        .when(F.col("now").eqNullSafe(F.col("old")), "skip")
        .when(same_language & (F.col("now_sha1") == F.col("old_sha1")), "touch")
        .otherwise("update")
    )
    return both.select("path", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def sync_counts(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """One row: how many rows a full synchronisation inserts, updates and removes."""
    a, b = old.select(F.col(key).alias("k"), F.lit(1).alias("o")), new.select(F.col(key).alias("k"), F.lit(1).alias("n"))
    both = a.join(b, "k", "full_outer")
    return both.agg(
        F.count_if(F.col("o").isNull()).alias("inserted"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("updated"), F.count_if(F.col("n").isNull()).alias("removed")
    )


def cascade_delete(tables: dict[str, DataFrame], file_ids: DataFrame, drop_files: bool = False) -> dict[str, DataFrame]:
    """All tables without what belongs to the files of ``file_ids`` (column ``file_id``).

    Gone symbols take the edges at either end with them; gone chunks their vectors and
    postings.
    """
    gone_symbols = tables["symbols"].join(file_ids, "file_id", "left_semi").select("id")
    gone_chunks = tables["chunks"].join(file_ids, "file_id", "left_semi").select(F.col("id").alias("chunk_id"))
    left = dict(tables)
    left["symbols"] = tables["symbols"].join(file_ids, "file_id", "left_anti")
    left["chunks"] = tables["chunks"].join(file_ids, "file_id", "left_anti")
    edges = tables["relations"]
    for end in ("source_symbol_id", "target_symbol_id"):
        edges = edges.join(gone_symbols.select(F.col("id").alias(end)), end, "left_anti")
    left["relations"] = edges.select(tables["relations"].columns)
    for name in ("chunk_embeddings", "postings", "doc_lengths"):
        if name in tables:
            left[name] = tables[name].join(gone_chunks, "chunk_id", "left_anti").select(tables[name].columns)
    if drop_files:
        left["files"] = tables["files"].join(file_ids.select(F.col("file_id").alias("id")), "id", "left_anti")
    return {name: left[name].select(tables[name].columns) for name in left}


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector, or with one of another model."""
    held = embeddings.select(F.col("chunk_id").alias("id"), "model")
    return chunks.join(held, "id", "left").where(F.col("model").isNull() | (F.col("model") != model)).drop("model")
