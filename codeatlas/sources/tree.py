"""Working trees as DataFrames: include and exclude globs, file details, texts."""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.text import language_of
from codeatlas.shared import shared_dir

INDEX_FOLDER = ".codeatlas"
#: What is scanned and what is left out unless a configuration says otherwise.
DEFAULT_INCLUDE = ("**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx")
DEFAULT_EXCLUDE = ("**/node_modules/**", "**/dist/**", "**/build/**", "**/.git/**", "**/coverage/**", f"**/{INDEX_FOLDER}/**")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob over relative paths; ``*`` also matches dot files."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
        elif pattern.startswith("**", i):
            out += ".*"
            i += 2
        elif pattern[i] == "*":
            out += "[^/]*"
            i += 1
        elif pattern[i] == "?":
            out += "[^/]"
            i += 1
        elif pattern[i] == "{" and "}" in pattern[i:]:
            end = pattern.index("}", i)
            out += "(?:" + "|".join(glob_regex(x)[1:-1] for x in pattern[i + 1 : end].split(",")) + ")"
            i = end + 1
        else:
            out += re.escape(pattern[i])
            i += 1
    return f"^{out}$"


def selected(path, include: tuple[str, ...] | list[str], exclude: tuple[str, ...] | list[str]):
    """Column predicate: some include glob matches and no exclude glob does."""
    keep = path.rlike("|".join(f"(?:{glob_regex(p)})" for p in include)) if include else F.lit(False)
    return keep & ~path.rlike("|".join(f"(?:{glob_regex(p)})" for p in exclude)) if exclude else keep


def _walk(root: str, include: list[str], exclude: list[str], budget: int):
    """Lists folders (``path``, below ``root``) and those in them until ``budget`` entries were seen; says which are left."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [re.compile(glob_regex(p)) for p in include]
        unwanted = [re.compile(glob_regex(p)) for p in exclude]
        system, top = pafs.FileSystem.from_uri(root)
        local, top = isinstance(system, pafs.LocalFileSystem), top.rstrip("/") + "/"
        for start in (x for batch in batches for x in batch.column(0).to_pylist()):
            todo, seen = deque([start]), 0
            while todo:
                rows = []
                if seen >= budget:
                    rows, todo = [(x, None, None, True) for x in todo], deque()
                else:
                    try:
                        entries = system.get_file_info(pafs.FileSelector(top + todo.popleft(), allow_not_found=True))
                    except PermissionError:  # as if it were empty
                        entries = []
                    seen += 1 + len(entries)
                    for entry in entries:
                        path = entry.path[len(top) :]
                        if entry.type == pafs.FileType.Directory:
                            linked = local and os.path.islink(entry.path)
                            if not linked and not any(p.match(f"{path}/x") for p in unwanted):
                                todo.append(path)
                        elif entry.type == pafs.FileType.File and any(p.match(path) for p in wanted) and not any(p.match(path) for p in unwanted):
                            rows.append((path, entry.size, entry.mtime_ns // 1_000_000, False))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_ENTRY.names, x)) for x in rows], schema=_ENTRY)

    return work


#: Entries that a task lists below one folder before it leaves the other folders to the next round.
BUDGET = 20_000
_ENTRY = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("mtime_ms", pa.int64()), ("left", pa.bool_())])


def list_tree(spark: SparkSession, root: str, include=DEFAULT_INCLUDE, exclude=DEFAULT_EXCLUDE, into: str | None = None, budget: int = BUDGET) -> DataFrame:
    """``path, language, size_bytes, mtime_ms`` of a tree that the executors can reach.

    A frontier of folders: each task lists one folder and those below it, up to ``budget`` entries, and hands on
    the folders it didn't come to, which are dealt out to all tasks of the next round. A small tree takes one round, a
    large one a few, whatever its shape, and no list of files passes through the driver. Excluded folders
    aren't entered, linked ones neither; unreadable ones count as empty. Rounds are kept in ``into``, a new folder
    that the caller may remove when it has read the rows, or one below the shared folder.
    """
    into = into or shared_dir(spark, "tree")
    base = re.sub(r"^file:/*", "/", root if re.match(r"^[a-z0-9]+:", root) else os.path.abspath(root))
    tasks = 4 * spark.sparkContext.defaultParallelism
    frontier, rounds = spark.range(1).select(F.lit("").alias("path")).coalesce(1), []
    while True:
        rounds.append(f"{into}/{len(rounds)}")
        found = frontier.mapInArrow(_walk(base, list(include), list(exclude), budget), "path string, size_bytes long, mtime_ms long, left boolean")
        found.write.parquet(rounds[-1])
        frontier = spark.read.schema(found.schema).parquet(rounds[-1]).where("left").select("path").repartition(tasks, "path")
        if frontier.isEmpty():
            break
    listed = spark.read.schema(found.schema).parquet(*rounds).where("not left")
    return listed.select("path", language_of("path").alias("language"), "size_bytes", "mtime_ms")


def read_tree(spark: SparkSession, root: str, include=DEFAULT_INCLUDE, exclude=DEFAULT_EXCLUDE, paths: list[str] | None = None) -> DataFrame:
    """``path, language, size_bytes, mtime_ms, text, sha1`` of a tree in any store Spark reads.

    The path filter is applied to the listing's columns; contents are read only for files
    that pass it. With ``paths`` (relative ones) no other files are looked at.
    """
    reader = spark.read.format("binaryFile")
    files = reader.option("recursiveFileLookup", True).load(root) if paths is None else reader.load([f"{root.rstrip('/')}/{p}" for p in paths])
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    absolute = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    rows = files.withColumn("full", absolute).withColumn("path", F.expr(f"substring(full, {len(base) + 1})"))
    kept = rows.where(selected(F.col("path"), include, exclude))
    return kept.select(
        "path",
        language_of("path").alias("language"),
        F.col("length").alias("size_bytes"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        F.decode("content", "UTF-8").alias("text"),
    ).withColumn("sha1", F.sha1(F.col("text").cast("binary")))
