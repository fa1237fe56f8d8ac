"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import drop_path, stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(both: DataFrame, least: DataFrame) -> DataFrame:
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every node with an edge; the component is its smallest node.

    ``edges`` has long columns ``u`` and ``v``. Large-star and small-star steps alternate
    until every node points at its smallest; each round is written to the shared folder.
    Self loops and repeated edges don't matter; an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now, path = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = _both_ways(now)
        # Read from storage, so that the join may split the edges of a node with very many.
        least, least_path = stored(_least(both), "least")
        after, new_path = stored(_small_star(_large_star(both, least)), "edges")
        drop_path(spark, least_path)
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_path(spark, path)
        now, path = after, new_path
        if tuple(mark) == state:
            break
        state = tuple(mark)
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
