"""Job: keep the inverted index of a growing folder of documents fresh.

Each run streams the files that the checkpoint hasn't seen, and ends. A document that
comes again with another text, language or source replaces its earlier version; one that comes
again unchanged is left alone, as a refresh of the index leaves unchanged files alone. Every
micro-batch writes partitions of its own, so the work follows the new files and not the index:

    <output>/postings/batch=N/language=L   doc_id, field, term, positions
    <output>/versions/batch=N              doc_id, fingerprint, language, path, length

A micro-batch that is tried again overwrites its own partitions and looks at earlier ones only,
so it ends with the same rows. The newest version of a document is the current one;
:func:`current` reads these.

Edge cases: rows without ``doc_id`` can't be told apart later and are counted and left out; a null text
has no terms but a version, and a null or empty language is ``unknown``; of several versions
in one micro-batch the longest stays, of equally long ones that with the greatest fingerprint; an empty
folder of documents leaves an empty index; other columns are not read.

    python -m jobs.refresh_search_index --config jobs/refresh_search_index.json
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeatlas.operators import search as S
from codeatlas.shared import exists, is_file
from jobs.settings import command, settings

LOG = logging.getLogger("refresh_search_index")

#: Characters of text that one task indexes, about.
TASK_CHARACTERS = 32 << 20

DOCUMENTS = "doc_id long, text string, lang string, source string"
POSTINGS = "doc_id long, field string, term string, positions array<int>, batch long, language string"
VERSIONS = "doc_id long, fingerprint string, language string, path string, length long, batch long"


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """One of the two tables, empty before the first run."""
    schema = {"postings": POSTINGS, "versions": VERSIONS}[name]
    path = f"{output}/{name}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def newest(versions: DataFrame) -> DataFrame:
    """The current version of each document."""
    return versions.groupBy("doc_id").agg(F.max_by("fingerprint", "batch").alias("fingerprint"), F.max("batch").alias("batch"))


def current(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the current versions, in the form that the search operators read."""
    versions = table(spark, output, "versions")
    last = newest(versions).select("doc_id", "batch")
    postings = table(spark, output, "postings").join(last, ["doc_id", "batch"], "left_semi")
    lengths = versions.join(last, ["doc_id", "batch"], "left_semi")
    return (
        postings.select(F.col("doc_id").alias("chunk_id"), F.col("field").alias("col"), "term", "positions", "language"),
        lengths.select(F.col("doc_id").alias("chunk_id"), "length"),
    )


def prepared(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, size, language, path, text`` of documents that have an id."""
    language = F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown"))
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), language, F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    text = F.coalesce("text", F.lit(""))
    return documents.where("doc_id IS NOT NULL").select(
        "doc_id", F.sha1(F.concat_ws("\n", path, text).cast("binary")).alias("fingerprint"), F.length(text).alias("size"), language.alias("language"), path.alias("path"), "text"
    )


def index_batch(batch: DataFrame, number: int, output: str) -> dict[str, int]:
    """Add the new and changed documents of one micro-batch to the index."""
    spark = batch.sparkSession
    versions = table(spark, output, "versions")
    if not versions.where(F.col("batch") > number).isEmpty():
        raise ValueError(f"{output} holds later batches than {number}: it was written with another checkpoint")
    size = batch.agg(F.count("*").alias("read"), F.count_if(F.col("doc_id").isNull()).alias("without_id"), F.sum(F.length("text")).alias("characters")).first()
    # Dealt out by the size of the batch, so that a task's texts and postings fit its memory.
    tasks = max(spark.sparkContext.defaultParallelism, -(-(size["characters"] or 0) // TASK_CHARACTERS))
    rows = prepared(batch).repartition(tasks, "doc_id")
    order = Window.partitionBy("doc_id").orderBy(F.col("size").desc(), F.col("fingerprint").desc())
    best = rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
    known = newest(versions.where(F.col("batch") < number)).select("doc_id", F.col("fingerprint").alias("known"))
    fresh = best.join(known, "doc_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("known")))

    # The two tables are written one after the other; the second needs documents without texts, and lengths from the first.
    fields = fresh.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("path").alias("file_path"), F.lit(None).cast("string").alias("symbol_name"), "language")
    index = S.postings(S.field_tokens(fields)).select(F.col("chunk_id").alias("doc_id"), F.col("col").alias("field"), "term", "positions", "language")
    index.write.mode("overwrite").partitionBy("language").parquet(f"{output}/postings/batch={number}")
    added = table(spark, output, "postings").where(F.col("batch") == number)
    lengths = added.groupBy("doc_id").agg(F.sum(F.size("positions")).cast("long").alias("length"))
    details = fresh.select("doc_id", "fingerprint", "language", "path")
    lengths = details.join(lengths, "doc_id", "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))
    lengths.write.mode("overwrite").parquet(f"{output}/versions/batch={number}")

    counts = {
        "read": size["read"],
        "without_id": size["without_id"],
        "indexed": table(spark, output, "versions").where(F.col("batch") == number).count(),
        "postings": table(spark, output, "postings").where(F.col("batch") == number).count(),
    }
    LOG.info("batch %d: read %d documents (%d without id), indexed %d, wrote %d postings", number, *counts.values())
    return counts


def refresh(spark: SparkSession, documents: str, output: str, checkpoint: str, files_per_batch: int = 1000) -> dict[str, int]:
    """Index the files of ``documents`` that are new since the last run with ``checkpoint``."""
    total = {"batches": 0, "read": 0, "without_id": 0, "indexed": 0, "postings": 0}

    def add(batch: DataFrame, number: int) -> None:
        counts = index_batch(batch, number, output)
        total["batches"] += 1
        for name, n in counts.items():
            total[name] += n

    LOG.info("reading new files of %s", documents)
    source = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch)
    if is_file(spark, documents):  # a stream watches folders: the one that holds the file, for files of its name
        folder, _, name = documents.rstrip("/").rpartition("/")
        source, documents = source.option("pathGlobFilter", name), folder
    source = source.parquet(documents)
    query = source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%d batches: read %d documents (%d without id), indexed %d, wrote %d postings to %s", *total.values(), output)
    return total


NAMES = {"documents": str, "output": str, "checkpoint": str, "files_per_batch": int}

if __name__ == "__main__":
    command("refresh_search_index", refresh, settings("jobs/refresh_search_index.json", NAMES))
