"""Watching a tree: a stream that ticks, and a comparison of the tree with the index at each tick."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeatlas.plans.service import CodeAtlas

log = logging.getLogger(__name__)


def ticks(spark: SparkSession) -> DataFrame:
    """A row for each micro-batch. A stream of files would miss files that only go."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()


def watch(atlas: CodeAtlas, checkpoint: str, once: bool = False, seconds: int = 5) -> StreamingQuery:
    """Refresh the index whenever files came, changed or went.

    The index holds the last state of each file, so each tick compares the listing with it; a tick that
    is run again finds nothing to do.
    """

    def refresh(_: DataFrame, number: int) -> None:
        pending = atlas.pending()
        if pending["freshness"] == "stale":
            log.info("tick %d: %d added, %d changed, %d removed", number, pending["added"], pending["changed"], pending["removed"])
            atlas.index()

    writer = ticks(atlas.spark).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()
