"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme under which Spark itself would open it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share.

    ``spark.checkpoint.dir`` names that folder. It is set here only where the session has none
    and all tasks run in the driver's process; elsewhere that is an error, as executors would
    write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="codeatlas-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{qualified(spark, base).rstrip('/')}/codeatlas/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder written by :func:`stored`, through Spark's own file system layer."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.exists(target) and system.getFileStatus(target).isFile()


def stored(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    With columns ``by`` the rows lie in folders of their values, so that a filter on these reads no others.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_dir(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(schema).parquet(path), path
