"""Exact deduplication as a stateful stream.

A stream of digests runs through keyed state on disk that never expires. The state of a
digest keeps its best row so far: a stable identifier and a locator (file and row) of the
content. Whoever shares a digest with another row is a hit, and for hits the full normalised
bytes are compared, so a digest collision splits the group instead of losing a text.

Given a folder for it, the state is retained: a later run streams only its new rows through it, and
finds copies of what any earlier run has seen. Best rows of earlier runs are read again at their
locators when a new row hits them, so their files must still be there.

Only DataFrame operations touch the rows. Texts leave the scan solely for hits; everything
else moves digests and locators.

Edge cases: null counts as empty, and all empty texts are one group; rows with null or
repeated ``doc_id`` are told apart by their locator, and a null one is kept only if there is no
other; repeated rows are copies, of which one stays; ties go to the smaller ``doc_id``, then to the
locator; an empty table gives an empty one; texts are read whole; columns other than
``doc_id`` and ``text`` are not read by :func:`exact_dedup`, and handed on as they are by
:func:`keep_best`, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.llm.common import drop_path, fresh, shared_dir, text_or_empty

WHITE = r"[\x20\x09-\x0D]+"
_STORE = "spark.sql.streaming.stateStore"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A digest is hot if its group holds more than this share of all rows; at most as many
#: digests as the inverse can be hot, so the set of hot ones is small whatever the input.
HOT_SHARE = 1 / 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def fingerprints(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """Digest, identifier, length and locator of each row of a table read from files."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").alias("id"),
        (F.sha2(normalised(text), 256) if digest is None else digest).alias("digest"),
        F.length(text).alias("size"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def _best() -> Column:
    """Most code points first, then the smallest identifier (null last), then the place."""
    return F.struct(
        (-F.col("size")).alias("order"), F.col("id").isNull().alias("unnamed"), F.col("id").alias("id"), F.col("file").alias("file"), F.col("row").alias("row")
    )


def stream_state(spark: SparkSession, keys: DataFrame, folder: str, once: bool) -> DataFrame:
    """Run a stream of fingerprints through the keyed state; the state's last content.

    ``keys`` is a streaming DataFrame of :func:`fingerprints`. Each micro-batch hands on the
    digests it changed; the newest row of a digest holds its final count and best row. ``once``
    says that there is a single micro-batch, in a folder of its own.
    """
    changed = keys.groupBy("digest").agg(F.count("*").alias("n"), F.min(_best()).alias("best"))
    target = f"{folder}/changes"

    def hand_on(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    settings = {
        f"{_STORE}.providerClass": ROCKS,
        f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
        f"{_STORE}.rocksdb.maxMemoryUsageMB": "256",
        # With a single micro-batch a store isn't used again; open ones each hold some MB of disk.
        f"{_STORE}.unloadOnCommit": str(once).lower(),
    }
    held = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        query = (
            changed.writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/state")
            .trigger(availableNow=True)
            .foreachBatch(hand_on)
            .start()
        )
        query.awaitTermination()
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    schema = "digest string, n long, best struct<order: int, unnamed: boolean, id: long, file: string, row: long>, batch long"
    rows = spark.read.schema(schema).parquet(target)
    if once:  # one micro-batch: each digest is there once
        return rows.drop("batch")
    return rows.groupBy("digest").agg(F.max_by(F.struct("n", "best"), "batch").alias("last")).select("digest", "last.n", "last.best")


def texts_of(docs: DataFrame, digest: Column | None) -> DataFrame:
    """Normalised text, digest, identifier, size and locator of each row of a table read from files."""
    text = normalised(text_or_empty())
    return docs.select(
        F.col("doc_id").alias("id"),
        (F.sha2(text, 256) if digest is None else digest).alias("digest"),
        F.length(text_or_empty()).alias("size"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        text.alias("text"),
    )


def texts_at(spark: SparkSession, places: DataFrame, digest: Column | None) -> DataFrame:
    """:func:`texts_of` of the rows at ``places`` (``file, row``), whichever run read them."""
    # Names of input files, which the driver has listed before.
    files = [r[0] for r in places.select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], "id long, digest string, size int, file string, row long, text string")
    return texts_of(spark.read.parquet(*files), digest).join(places, ["file", "row"], "left_semi")


def collisions(texts: DataFrame, hits: DataFrame, total: int) -> DataFrame:
    """Digests of ``hits`` (``digest, n``) under which ``texts`` differ in their full bytes.

    Copies of a text are reduced to their smallest and largest within each task before
    anything is shuffled by digest. Hot digests, of which there are few, meet the texts
    where they lie; the others go through a join by digest.
    """
    limit = max(2, int(total * HOT_SHARE))
    hot = F.broadcast(hits.where(F.col("n") > limit).select("digest"))
    cold = hits.where(F.col("n") <= limit).select("digest")
    met = texts.join(hot, "digest", "left_semi").unionByName(texts.join(cold, "digest", "left_semi"))
    return met.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least != most").select("digest")


def exact_dedup(docs: DataFrame, files_per_batch: int | None = None, digest: Column | None = None, state_folder: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256`` and its locator.

    ``docs`` is read from Parquet files. ``digest`` replaces SHA-256 of the normalised text
    as the state's key (tests use a short one to force collisions). With a ``state_folder`` the state
    is retained there and ``docs`` joins what earlier runs with that folder have read: groups,
    ``keep_id`` and ``group_size`` then reach over all runs.
    """
    spark = docs.sparkSession
    retained = state_folder is not None
    folder = state_folder if retained else shared_dir(spark, "exact")
    prints = fingerprints(docs, digest)
    mine = f"{folder}/keys/{uuid.uuid4().hex}"
    prints.write.parquet(mine)
    keys = spark.read.schema(prints.schema).parquet(mine)
    every = spark.read.schema(prints.schema).parquet(f"{folder}/keys/*") if retained else keys
    source = spark.readStream.schema(prints.schema)
    if files_per_batch is not None:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    state = stream_state(spark, source.parquet(f"{folder}/keys/*"), folder, not retained and files_per_batch is None)
    hits = state.where("n > 1")
    texts = texts_of(docs, digest).select("digest", "text")
    if retained:
        # The text that a row hit may have come with an earlier run.
        hits = hits.join(keys.select("digest").distinct(), "digest", "left_semi")
        here = keys.select("file").distinct()
        places = hits.select("best.file", "best.row").join(here, "file", "left_anti")
        texts = texts.unionByName(texts_at(spark, places, digest).select("digest", "text"))
    split = collisions(texts, hits.select("digest", "n"), every.count())
    found = f"{folder}/collisions/{uuid.uuid4().hex}"
    split.write.parquet(found)
    split = spark.read.schema(split.schema).parquet(found)
    if not retained:
        drop_path(spark, f"{folder}/state")
    if not split.isEmpty():
        keys, state = _by_bytes(spark, keys, every, state, split, digest)
    return keys.join(state, "digest").select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))).alias("kept"),
        F.substring_index("digest", "/", -1).alias("text_sha256"),
        "file",
        "row",
    )


def _by_bytes(spark: SparkSession, keys: DataFrame, every: DataFrame, state: DataFrame, split: DataFrame, digest: Column | None) -> tuple[DataFrame, DataFrame]:
    """Give rows under a collided digest a key of digest, text order and true SHA-256."""
    rows = texts_at(spark, every.join(split, "digest", "left_semi").select("file", "row"), digest)
    groups = rows.groupBy("digest", "text").agg(F.count("*").alias("n"), F.min(_best()).alias("best"))
    named = groups.withColumn("key", F.concat_ws("/", "digest", F.col("best.file"), F.col("best.row"), F.sha2("text", 256)))
    again = rows.join(named.select("digest", "text", "key"), ["digest", "text"]).select("id", F.col("key").alias("digest"), "size", "file", "row")
    return (
        keys.join(split, "digest", "left_anti").unionByName(again.join(keys.select("file", "row"), ["file", "row"], "left_semi").select(*keys.columns)),
        state.join(split, "digest", "left_anti").unionByName(named.select(F.col("key").alias("digest"), "n", "best")),
    )


def keep_best(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    file, row = fresh("kept_file", docs), fresh("kept_row", docs)
    kept = exact_dedup(docs).where("kept").select(F.col("file").alias(file), F.col("row").alias(row))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    placed = docs.select(*columns, F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    return placed.join(kept, [file, row], "left_semi").select(*columns)
