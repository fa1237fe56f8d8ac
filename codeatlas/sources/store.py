"""Snapshots of the index tables: a folder for each version, and a pointer to the current one."""

from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession

from codeatlas.shared import drop_path, shared_dir
from codeatlas.sources.schema import SCHEMA_VERSION, TABLES, empty, migrated
from codeatlas.sources.tree import INDEX_FOLDER


#: Seconds for which a snapshot stays after the next one took its place, for those who still read it.
GRACE = 120


class IndexStore:
    """Index of a repository below its root; readers see one whole snapshot."""

    def __init__(self, spark: SparkSession, root: str, grace: float = GRACE):
        self.spark, self.root, self.grace = spark, os.path.abspath(root), grace
        self._stage: str | None = None
        self.folder = os.path.join(self.root, INDEX_FOLDER, "index")

    @property
    def pointer(self) -> str:
        return os.path.join(self.folder, "CURRENT")

    def current(self) -> str | None:
        """Folder of the current snapshot; a name that is gone counts as none."""
        if not os.path.exists(self.pointer):
            return None
        with open(self.pointer, encoding="utf-8") as file:
            path = os.path.join(self.folder, file.read().strip())
        return path if os.path.isdir(path) else None

    def exists(self) -> bool:
        return self.current() is not None

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot in the current schema, empty where it is missing."""
        at = self.current()
        path = f"{at}/{name}.parquet"
        if at is None or not os.path.isdir(path):
            return empty(self.spark, name)
        return migrated(self.spark.read.parquet(f"file://{path}"), name)

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    def metadata(self, key: str) -> str | None:
        row = self.table("index_metadata").where(f"key = '{key}'").select("value").first()
        return row[0] if row else None

    def ensure(self) -> None:
        """An empty snapshot where there is none; does nothing otherwise."""
        if not self.exists():
            meta = self.spark.createDataFrame([("schema_version", SCHEMA_VERSION)], TABLES["index_metadata"])
            self.write({name: empty(self.spark, name) for name in TABLES} | {"index_metadata": meta})

    def stage(self, name: str) -> str:
        """A place for intermediate rows of the next snapshot, in the folder that executors share."""
        self._stage = self._stage or shared_dir(self.spark, "stage")
        return f"{self._stage}/{name}"

    def unstage(self) -> None:
        """Remove intermediate rows, which a written snapshot doesn't need."""
        if self._stage:
            drop_path(self.spark, self._stage)
            self._stage = None

    def write(self, tables: dict[str, DataFrame]) -> str:
        """Write a whole snapshot, then move the pointer to it.

        A failure before the last step leaves the old snapshot in force. Older ones are removed by the first write
        that comes more than ``grace`` seconds after they were replaced, so a read that was begun on one can end.
        """
        os.makedirs(self.folder, exist_ok=True)
        old = [d for d in os.listdir(self.folder) if d.startswith("snap_")]
        number = max((int(d.removeprefix("snap_")) for d in old), default=0) + 1
        name = f"snap_{number}"
        for table, df in tables.items():
            migrated(df, table).write.mode("overwrite").parquet(f"file://{self.folder}/{name}/{table}.parquet")
        draft = f"{self.pointer}.{number}"
        with open(draft, "w", encoding="utf-8") as file:
            file.write(name)
        os.replace(draft, self.pointer)
        self._expire([*old, name])
        return name

    def _expire(self, names: list[str]) -> None:
        """Remove snapshots whose follower is older than the grace time."""
        ordered = sorted(names, key=lambda d: int(d.removeprefix("snap_")))
        for d, follower in zip(ordered, ordered[1:]):
            if time.time() - os.path.getmtime(os.path.join(self.folder, follower)) >= self.grace:
                shutil.rmtree(os.path.join(self.folder, d), ignore_errors=True)
