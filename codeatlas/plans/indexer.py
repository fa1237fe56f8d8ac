"""Building and refreshing an index from a working tree."""

from __future__ import annotations

import logging
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.text import by_locale, is_source, signature_of
from codeatlas.operators import maintenance as M
from codeatlas.operators import search as S
from codeatlas.operators.ids import numbered
from codeatlas.operators.inference import inferred_refs
from codeatlas.operators.program import Keep, dependent_files, facts, in_shared_folder, module_edges, named, needed_files, semantic_refs
from codeatlas.operators.relations import dedupe_targets, resolve_targets
from codeatlas.plans.providers import resolve_provider
from codeatlas.sources.parser import parse_files
from codeatlas.sources.schema import SCHEMA_VERSION, TABLES
from codeatlas.sources.store import IndexStore
from codeatlas.sources.tree import list_tree, read_tree

log = logging.getLogger(__name__)

NOTHING = {"scanned": 0, "inserted": 0, "updated": 0, "removed": 0, "symbols": 0, "relations": 0, "chunks": 0}


def _highest(df: DataFrame) -> int:
    return df.agg(F.max("id")).first()[0] or 0


def symbol_rows(parsed: DataFrame, files: DataFrame, first: int, stage: str) -> DataFrame:
    """Symbols of parsed files with ids, content and parent, numbered from ``first`` by path and order of appearance."""
    declared = parsed.where("fact = 'symbol'").select(
        "path", "ord", F.col("a").alias("key"), F.col("b").alias("name"), F.col("c").alias("kind"), F.col("d").alias("parent"), "start_line", "end_line", F.col("flag").alias("exported")
    )
    content = parsed.where("fact = 'content'").select("path", "ord", F.col("a").alias("content"))
    with_ids = numbered(declared.join(content, ["path", "ord"]), [*by_locale("path"), "ord"], first, stage)
    with_ids = with_ids.join(files.select("path", F.col("id").alias("file_id")), "path")
    owners = with_ids.where("kind = 'class'").select("path", F.concat(F.lit("class:"), "name").alias("owner_key"), F.col("id").alias("owner_id"), F.col("ord").alias("owner_ord"))
    owned = with_ids.withColumn("owner_key", F.concat(F.lit("class:"), "parent")).join(owners, ["path", "owner_key"], "left")
    # The nearest class of that name before the method.
    before = F.when(F.col("owner_ord") < F.col("ord"), F.struct("owner_ord", "owner_id"))
    parents = owned.groupBy("id").agg(F.max(before).alias("owner")).select("id", F.col("owner.owner_id").alias("parent_symbol_id"))
    return with_ids.join(parents, "id")


def stored_symbols(rows: DataFrame) -> DataFrame:
    """The symbol table's columns of :func:`symbol_rows`."""
    return rows.select("id", "file_id", "parent_symbol_id", "name", "kind", signature_of(F.col("kind"), F.col("content"), F.col("name")).alias("signature"), "start_line", "end_line", "exported")


def build_relations(parsed: DataFrame, symbols: DataFrame, files: DataFrame, keep: Keep = in_shared_folder, only: DataFrame | None = None) -> DataFrame:
    """Edges of the whole program: references of each file and across files, resolved to symbols.

    ``parsed``: facts of all files; ``symbols`` and ``files``: their stored rows. With ``only`` (``path``) these
    are the edges that start in some files; facts of what they import, all the way, must be there.
    """
    declared = facts(parsed, "symbol", a="key", b="name", c="kind", d="parent").join(parsed.where("fact = 'symbol'").select("path", "ord", "start_line", "end_line"), ["path", "ord"])
    stored = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    parents = symbols.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("parent_name"))
    placed = stored.join(parents, "parent_symbol_id", "left")
    same = ["path", "kind", "name", "start_line", "end_line"]
    identified = declared.join(placed.select("id", "file_id", "parent_name", *same), same).where(F.col("parent").eqNullSafe(F.col("parent_name")))
    # Several declarations under one local key: their edges start at the last one.
    sources = keep(
        identified.groupBy("path", "key")
        .agg(F.max_by(F.struct("id", "file_id"), F.struct("ord", "id")).alias("s"))
        .select("path", "key", F.col("s.id").alias("source_id"), F.col("s.file_id").alias("source_file")),
        "sources",
    )
    syntactic = facts(parsed, "ref", a="key", b="target_name", c="target_parent").select("path", "key", "target_name", "target_parent", "ord")
    source_files = parsed.where(is_source("path"))
    names = named(source_files, keep)
    followed = semantic_refs(source_files, keep, names).unionByName(inferred_refs(source_files, keep, names))
    semantic = followed.select("path", F.col("source").alias("key"), "target_name", "target_parent", F.lit(1 << 30).alias("ord"))
    refs = syntactic.unionByName(semantic).join(sources, ["path", "key"])
    if only is not None:
        refs = refs.join(only, "path", "left_semi")
    unique = dedupe_targets(refs, "source_id").withColumn("ref_id", F.xxhash64("target_name", "target_parent"))
    wanted = unique.join(sources.select("source_id", "source_file").distinct(), "source_id")
    found = resolve_targets(wanted, placed.select("id", "name", "parent_name", "file_id", "path", "start_line", "exported"))
    return found.select(F.col("source_id").alias("source_symbol_id"), F.col("target_id").alias("target_symbol_id"), F.lit("calls").alias("relation_type"), "ref_id")


def affected_files(facts_now: DataFrame, facts_before: DataFrame, reworked: DataFrame, keep: Keep = in_shared_folder) -> DataFrame:
    """``path`` of the files whose edges a change may move.

    These are the reworked files and those that import from them, directly or by way of others, as types and names
    flow along imports, and files that mean a name by itself that a reworked file declares or declared.
    """
    edges = module_edges(facts_now).unionByName(module_edges(facts_before.join(reworked, "path", "left_semi"))).distinct()
    dependents = dependent_files(edges, reworked, keep)
    declared = facts(facts_now.unionByName(facts_before), "symbol", b="name").join(reworked, "path", "left_semi").select("name").distinct()
    meant = facts(facts_now, "ref", b="name").select("path", "name").unionByName(facts(facts_now, "chain", c="steps").select("path", F.substring_index("steps", ".", -1).alias("name")))
    meant = meant.unionByName(facts(facts_now, "infer", d="steps").select("path", F.explode(F.regexp_extract_all("steps", F.lit('"m":"([^"]+)"'), 1)).alias("name")))
    named = meant.distinct().join(keep(declared, "declared"), "name", "left_semi").select("path")
    return keep(dependents.unionByName(named).distinct(), "affected")


def refreshed_relations(
    relations: DataFrame, facts_now: DataFrame, facts_before: DataFrame, reworked: DataFrame, symbols: DataFrame, files: DataFrame, keep: Keep = in_shared_folder
) -> DataFrame:
    """Edges after a change: old ones of files that it can't have moved, and new ones of the others.

    ``relations`` are the old edges whose ends are still there; ``facts_before`` and ``facts_now``: facts of all files
    before and after; ``reworked``: paths that came, changed or went. New edges have no ``id`` yet.
    """
    affected = affected_files(facts_now, facts_before, reworked, keep)
    needed = needed_files(module_edges(facts_now), files, affected, keep)
    some = keep(facts_now.join(needed, "path", "left_semi"), "needed_facts")
    edges = build_relations(some, symbols, files, keep, affected).withColumn("id", F.lit(None).cast("long"))
    owners = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("id").alias("source_symbol_id"), "path")
    kept = relations.join(owners, "source_symbol_id").join(affected, "path", "left_anti").withColumn("ref_id", F.lit(None).cast("long"))
    columns = ["id", "source_symbol_id", "target_symbol_id", "relation_type", "ref_id"]
    return kept.select(*columns).unionByName(edges.select(*columns))


def index_repository(spark: SparkSession, root: str, config: dict[str, Any]) -> dict[str, int]:
    """Bring the index in line with the tree; how many rows that took.

    Files are compared by their details, then by content. Only changed files get new symbols
    and chunks, and only edges that a change can have moved are made anew. Everything goes into one
    new snapshot; intermediate rows are removed in the end, after a failure too.
    """
    store = IndexStore(spark, root)
    try:
        return _indexed(spark, root, config, store)
    finally:
        store.unstage()


def _indexed(spark: SparkSession, root: str, config: dict[str, Any], store: IndexStore) -> dict[str, int]:
    store.ensure()
    tables = store.tables()
    include, exclude = config["include"], config["exclude"]
    listed = list_tree(spark, root, include, exclude, store.stage("listing"))
    changes = M.pending_changes(listed, tables["files"]).first()
    provider = resolve_provider(config)
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    result = dict(NOTHING)
    if changes["freshness"] == "stale":
        tables, result = _refreshed(spark, listed, store, tables, include, exclude, now)
    if provider is not None:
        missing = M.missing_embeddings(tables["chunks"], tables["chunk_embeddings"], provider.model)
        new = missing.select(
            F.col("id").alias("chunk_id"), F.lit(provider.model).alias("model"), F.lit(provider.dimensions).alias("dimensions"), provider.embed(F.col("content")).alias("embedding"), F.lit(now).alias("updated_at")
        ).where(F.size("embedding") > 0)
        try:
            new.write.mode("overwrite").parquet(store.stage("vectors"))
        except Exception as error:  # a provider may fail in any way; the index is useful without vectors
            log.warning("no vectors were added: %s", error)
        else:
            new = spark.read.schema(new.schema).parquet(store.stage("vectors"))
            tables["chunk_embeddings"] = M.upsert(tables["chunk_embeddings"], new, "chunk_id")
    meta = spark.createDataFrame([("schema_version", SCHEMA_VERSION), ("last_indexed_at", now)], TABLES["index_metadata"])
    tables["index_metadata"] = M.upsert(tables["index_metadata"], meta, "key")
    store.write(tables)
    return result


def _refreshed(spark: SparkSession, details: DataFrame, store: IndexStore, tables: dict[str, DataFrame], include, exclude, now: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Tables after the changes of the tree (``details``: its listing), and the counters."""

    def staged(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(store.stage(name))
        return spark.read.schema(df.schema).parquet(store.stage(name))

    held = tables["files"].select("path", F.col("sha1").alias("old_sha1"), F.col("size_bytes").alias("old_size"), F.col("mtime_ms").alias("old_mtime"))
    listed = details.join(held, "path", "left")
    # An index without facts, a new one or one of an older version, needs all texts.
    whole = tables["facts"].isEmpty()
    moved = ~(F.col("size_bytes").eqNullSafe(F.col("old_size")) & F.col("mtime_ms").eqNullSafe(F.col("old_mtime")))
    # The reader takes its paths from the driver: changed files of one repository, or none listed for a new index.
    wanted = None if whole else [r[0] for r in listed.where(moved).select("path").collect()]
    columns = ["path", "text", "sha1"]
    texts = spark.createDataFrame([], "path string, text string, sha1 string") if wanted == [] else read_tree(spark, f"file://{store.root}", include, exclude, wanted).select(columns)
    tree = staged(
        listed.join(texts, "path", "left").withColumn("sha1", F.coalesce("sha1", "old_sha1")).where("sha1 is not null").drop("old_sha1", "old_size", "old_mtime"), "tree"
    )
    actions = staged(M.classify(tree, tables["files"]), "actions")
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}  # at most five rows
    result = NOTHING | {"removed": counts.get("remove", 0), "inserted": counts.get("insert", 0), "updated": counts.get("touch", 0) + counts.get("update", 0)}
    result["scanned"] = counts.get("insert", 0) + counts.get("update", 0)

    # Files keep their id; new ones follow the highest.
    kept_ids = tables["files"].select("path", "id", F.col("updated_at").alias("old_at"))
    known = tree.join(actions, "path").join(kept_ids, "path", "left")
    new = numbered(known.where("id is null").drop("id"), by_locale("path"), _highest(tables["files"]) + 1, store.stage("file_ids"))
    stamped = F.when(F.col("action") == "skip", F.col("old_at")).otherwise(F.lit(now)).alias("updated_at")
    columns = ["id", "path", "language", "sha1", stamped, "size_bytes", "mtime_ms"]
    files = staged(known.where("id is not null").select(*columns).unionByName(new.select(*columns)), "files")
    replaced = result["scanned"] + result["removed"] > 0
    if not replaced:
        return tables | {"files": files}, result

    reworked = actions.where("action in ('insert', 'update', 'remove')").select("path")
    old_ids = tables["files"].join(reworked, "path", "left_semi").select(F.col("id").alias("file_id"))
    left = M.cascade_delete({k: v for k, v in tables.items() if k not in ("index_metadata", "facts")}, old_ids)
    # Changed files are parsed; facts of the others are those of the last snapshot.
    fresh = actions.where("action in ('insert', 'update')").select("path")
    parsed = staged(parse_files(tree if whole else tree.join(fresh, "path", "left_semi")), "parsed")
    facts_now = staged(tables["facts"].join(reworked, "path", "left_anti").unionByName(parsed.where("fact != 'content'")), "facts")

    rows = staged(symbol_rows(parsed.join(fresh, "path", "left_semi"), files, _highest(tables["symbols"]) + 1, store.stage("symbol_ids")), "symbol_rows")
    symbols = left["symbols"].unionByName(stored_symbols(rows))
    first_chunk = _highest(tables["chunks"]) + 1
    numbers = numbered(rows.select(F.col("id").alias("symbol_id")), ["symbol_id"], first_chunk, store.stage("chunk_ids"))
    new_chunks = rows.withColumnRenamed("id", "symbol_id").join(numbers, "symbol_id").select(
        "id", "file_id", "symbol_id", F.lit("symbol").alias("chunk_type"), "content", "start_line", "end_line", F.sha1(F.col("content").cast("binary")).alias("content_sha1")
    )
    new_chunks = staged(new_chunks, "new_chunks")
    tokens = staged(S.field_tokens(S.searchable(new_chunks, files, symbols)), "tokens")
    all_symbols = staged(symbols, "symbols")
    if whole:
        unnumbered = build_relations(facts_now, all_symbols, files, staged)
        kept_edges = tables["relations"].limit(0)
    else:
        known_facts = tables["facts"].select(*facts_now.columns)
        both = staged(refreshed_relations(left["relations"], facts_now, known_facts, reworked, all_symbols, files, staged), "edges")
        kept_edges, unnumbered = both.where("id is not null").drop("ref_id"), both.where("id is null").drop("id")
    new_edges = numbered(unnumbered, ["source_symbol_id", "target_symbol_id", "ref_id"], 1 if whole else _highest(tables["relations"]) + 1, store.stage("edge_ids"))
    edge_columns = ["id", "source_symbol_id", "target_symbol_id", "relation_type"]
    edges = kept_edges.select(*edge_columns).unionByName(new_edges.select(*edge_columns))
    after = tables | left | {
        "files": files,
        "facts": facts_now,
        "symbols": all_symbols,
        "chunks": left["chunks"].unionByName(new_chunks),
        "relations": staged(edges, "relations"),
        "postings": left["postings"].unionByName(S.postings(tokens, porter=True)),
        "doc_lengths": left["doc_lengths"].unionByName(S.doc_lengths(tokens)),
    }
    result |= {"symbols": rows.count(), "chunks": new_chunks.count(), "relations": after["relations"].count()}
    return after, result
