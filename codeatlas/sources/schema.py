"""Fixed schemas of the index tables (version 2), empty tables and additive migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "2"

TABLES: dict[str, str] = {
    "index_metadata": "key string, value string",
    "files": "id long, path string, language string, sha1 string, updated_at string, size_bytes long, mtime_ms long",
    "symbols": "id long, file_id long, parent_symbol_id long, name string, kind string, signature string, start_line int, end_line int, exported boolean",
    "relations": "id long, source_symbol_id long, target_symbol_id long, relation_type string",
    "chunks": "id long, file_id long, symbol_id long, chunk_type string, content string, start_line int, end_line int, content_sha1 string",
    "chunk_embeddings": "chunk_id long, model string, dimensions int, embedding array<double>, updated_at string",
    "postings": "term string, chunk_id long, col string, positions array<int>",
    "doc_lengths": "chunk_id long, length long",
    "facts": "path string, fact string, ord int, a string, b string, c string, d string, start_line int, end_line int, flag boolean",
}
#: Columns added since version 1, with their default.
ADDED = {"files": {"size_bytes": 0, "mtime_ms": 0}}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def migrated(df: DataFrame, table: str) -> DataFrame:
    """The columns of the current schema, in order; missing ones get their default or null."""
    added = ADDED.get(table, {})
    held = set(df.columns)
    columns = []
    for part in TABLES[table].split(", "):
        name, kind = part.split(" ", 1)
        columns.append((F.col(name) if name in held else F.lit(added.get(name))).cast(kind).alias(name))
    return df.select(*columns)
