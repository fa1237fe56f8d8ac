"""Job: report on the call graph, one row for each symbol.

For people who are about to change or remove code: how many symbols call each one, how many of
them from other files, what it calls itself, who is the first caller by place, and its role:

    hub       called from other files by at least ``hub_callers`` symbols
    shared    called, and calls others
    leaf      called, and calls nobody
    entry     exported, not called
    unused    neither exported nor called

A symbol that only calls itself counts as not called. The report is partitioned by role, and a
run replaces all of it, so that the same tables give the same report.

    python -m jobs.call_report --config jobs/call_report.json
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.operators.selector import place
from codeatlas.sources.virtual import VirtualIndex
from jobs.settings import command, settings

LOG = logging.getLogger("call_report")

REPORT = "id long, path string, parent_name string, name string, kind string, start_line int, exported boolean, callers long, outside_callers long, callees long, recursive boolean, first_caller string, first_caller_path string, role string"


def call_report(symbols: DataFrame, files: DataFrame, relations: DataFrame, hub_callers: int) -> DataFrame:
    """A row for each symbol. Edges are counted before they meet symbols' names, so a popular symbol costs one row there."""
    placed = place(symbols, files).select("id", "file_id", "path", "parent_name", "name", "kind", "start_line", "exported")
    edges = relations.select(F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target")).distinct()
    callers = placed.select(F.col("id").alias("source"), F.col("file_id").alias("source_file"), F.struct("path", "start_line", "id", "name").alias("caller"))
    targets = placed.select(F.col("id").alias("target"), F.col("file_id").alias("target_file"))
    met = edges.where("source != target").join(callers, "source").join(targets, "target")
    called = met.groupBy(F.col("target").alias("id")).agg(
        F.count("*").alias("callers"), F.count_if(F.col("source_file") != F.col("target_file")).alias("outside_callers"), F.min("caller").alias("first")
    )
    calls = edges.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("source") != F.col("target")).alias("callees"), F.max(F.col("source") == F.col("target")).alias("recursive"))
    whole = placed.join(called, "id", "left").join(calls, "id", "left")
    n_in, n_out, n_outside = (F.coalesce(c, F.lit(0).cast("long")) for c in ("callers", "callees", "outside_callers"))
    role = (
        F.when(n_outside >= hub_callers, "hub")
        .when((n_in > 0) & (n_out > 0), "shared")
        .when(n_in > 0, "leaf")
        .when(F.col("exported"), "entry")
        .otherwise("unused")
    )
    return whole.select(
        "id", "path", "parent_name", "name", "kind", "start_line", "exported",
        n_in.alias("callers"), n_outside.alias("outside_callers"), n_out.alias("callees"), F.coalesce("recursive", F.lit(False)).alias("recursive"),
        F.col("first.name").alias("first_caller"), F.col("first.path").alias("first_caller_path"), role.alias("role"),
    )


def written(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(output)


def report(spark: SparkSession, tables: str, output: str, hub_callers: int = 25) -> dict[str, int]:
    """Write the report on the call graph of ``tables``."""
    index = VirtualIndex(spark, tables)
    LOG.info("reading parts and lines of orders of %s", tables)
    rows = call_report(index.symbols(), index.symbol_files(), index.relations(), hub_callers)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("role").parquet(output)
    counts = {r["role"]: r["count"] for r in written(spark, output).groupBy("role").count().collect()}  # at most five rows
    LOG.info("wrote %d symbols to %s: %s", sum(counts.values()), output, ", ".join(f"{n} {role}" for role, n in sorted(counts.items())))
    return counts


NAMES = {"tables": str, "output": str, "hub_callers": int}

if __name__ == "__main__":
    command("call_report", report, settings("jobs/call_report.json", NAMES))
