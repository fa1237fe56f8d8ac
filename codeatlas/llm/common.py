"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeatlas.packaging import ship
from codeatlas.shared import drop_path, qualified, shared_dir, stored

__all__ = ["drop_path", "fresh", "mapped", "qualified", "read_table", "release", "shared_dir", "shuffle_partitions", "small_batches", "stored", "text_or_empty"]

#: Rows and bytes handed to a Python worker at once; keeps a batch of long texts small.
ARROW_ROWS, ARROW_BYTES = 256, 4 << 20


def release(spark: SparkSession) -> None:
    """Let the driver collect what it no longer refers to, so that old shuffle files go."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    """Bound rows and bytes of an Arrow batch, as texts may be very long; the workers get the package."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(name).lower().removesuffix("b")
        if not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[Any]], schema: T.StructType) -> DataFrame:
    """``df`` through ``run``, which gets Arrow batches and yields rows (tuples) or columns by name.

    Values don't pass through pandas, where a null beside them would turn 64-bit ids into floats.
    """
    small_batches(df.sparkSession)
    made = to_arrow_schema(schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            if isinstance(out, dict):
                columns = [out[name] for name in made.names]
            else:
                columns = list(zip(*out, strict=True)) if out else [()] * len(made)
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, made, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=made)

    return df.mapInArrow(whole, schema)


def fresh(name: str, *taken: DataFrame) -> str:
    """``name``, or with underscores behind it, so that no column of ``taken`` has it."""
    held = {c.lower() for df in taken for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))
