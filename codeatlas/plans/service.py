"""The engine's operations on a repository: index, search, symbols, callers, callees, status."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.text import query_tokens, text_plans
from codeatlas.operators import maintenance as M
from codeatlas.operators import search as S
from codeatlas.operators import symbols as G
from codeatlas.operators.selector import candidates, parse_selector, place
from codeatlas.plans.indexer import index_repository
from codeatlas.plans.providers import resolve_provider
from codeatlas.shared import drop_path, shared_dir
from codeatlas.sources.config import InvalidInput, check_limit, check_query, config_path, find_root, load_config, parse_config, save_config
from codeatlas.sources.store import IndexStore
from codeatlas.sources.tree import INDEX_FOLDER, list_tree

POLICIES = ("warn", "fail", "auto-index-light")
COUNTED = ("files", "symbols", "relations", "chunks")


def failure(code: str, message: str, retryable: bool = False) -> dict[str, Any]:
    return {"ok": False, "error": {"code": code, "message": message, "retryable": retryable}}


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]


class CodeAtlas:
    """Operations on one repository. Results are plain values; failures are returned, not raised."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, find_root(root)
        self.store = IndexStore(spark, self.root)

    # -- upkeep -----------------------------------------------------------

    def init(self) -> dict[str, Any]:
        there = os.path.exists(config_path(self.root)) and self.store.exists()
        if not os.path.exists(config_path(self.root)):
            save_config(self.root, parse_config({}))
        self.store.ensure()
        return {"ok": True, "root": self.root, "config_path": config_path(self.root), "index_path": self.store.folder, "already_initialized": there}

    def index(self) -> dict[str, Any]:
        if not os.path.exists(config_path(self.root)):
            return failure("REPO_NOT_INITIALIZED", "the repository is not initialized")
        try:
            return {"ok": True} | index_repository(self.spark, self.root, load_config(self.root))
        except (InvalidInput, OSError, ValueError) as error:
            return failure("FS_ERROR", str(error), True)

    def pending(self) -> dict[str, Any]:
        config = load_config(self.root)
        into = shared_dir(self.spark, "pending")
        try:
            listed = list_tree(self.spark, self.root, config["include"], config["exclude"], into)
            return M.pending_changes(listed, self.store.table("files")).first().asDict()
        finally:
            drop_path(self.spark, into)

    def _ready(self, policy: str) -> dict[str, Any]:
        """Check the index before a read; ``{"ok", "stale"}`` or a failure."""
        if policy not in POLICIES:
            return failure("INVALID_INPUT", f"policy: one of {', '.join(POLICIES)} is expected")
        if not os.path.exists(config_path(self.root)) or not self.store.exists():
            return failure("REPO_NOT_INITIALIZED", "the repository is not initialized")
        if self.pending()["freshness"] == "fresh":
            return {"ok": True, "stale": False}
        if policy == "warn":
            return {"ok": True, "stale": True}
        if policy == "fail":
            return failure("INDEX_STALE", "the index is out of date", True)
        done = self.index()
        return {"ok": True, "stale": False} if done["ok"] else failure("INDEX_REFRESH_FAILED", done["error"]["message"], True)

    # -- reads ------------------------------------------------------------

    def query(self, text: str, limit: int = S.DEFAULT_LIMIT, policy: str = "auto-index-light") -> dict[str, Any]:
        """Search: an exact symbol name answers alone, else full text, with vectors where there are any."""
        try:
            text, limit = check_query(text, limit)
        except InvalidInput as error:
            return failure("INVALID_INPUT", str(error))
        ready = self._ready(policy)
        if not ready["ok"]:
            return ready
        t = self.store.tables()
        fields = ("file_path", "symbol_name", "start_line", "end_line", "score", "rationale")
        exact = _rows(S.exact_route(t["symbols"], t["files"], t["chunks"], text, limit).select(*fields))
        if exact:
            return {"ok": True, "route": "symbol", "stale": ready["stale"], "hits": exact}
        tokens = query_tokens(text)
        expansion = S.expand(t["symbols"], t["files"], tokens, limit)
        lists = [S.top_candidates(S.bm25(t["postings"], t["doc_lengths"], plan, porter=True), limit) for plan in text_plans(text)]
        merged = S.merge_candidates(lists).persist()  # at most two lists of bounded length
        names = t["symbols"].select(F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"))
        details = (
            t["chunks"]
            .join(t["files"].select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
            .join(names, "symbol_id", "left")
            .select(F.col("id").alias("chunk_id"), "content", "file_path", "symbol_name", "start_line", "end_line")
        )
        provider = resolve_provider(load_config(self.root))
        sims, route = None, "fts"
        if provider is not None:
            vector = provider.embed_value(self.spark, text)
            sims = S.similarities(merged, t["chunk_embeddings"], provider.model, vector).persist()
            if not sims.isEmpty():
                route = "hybrid"
        hits = _rows(S.ranked_hits(merged, details, text, tokens, expansion, limit, sims).select(*fields))
        merged.unpersist()
        return {"ok": True, "route": route, "stale": ready["stale"], "hits": hits}

    def symbol(self, name: str, limit: int = G.LOOKUP_LIMIT) -> dict[str, Any]:
        return self._graph("symbol", name, limit, 20)

    def callers(self, name: str, limit: int = G.GRAPH_LIMIT) -> dict[str, Any]:
        return self._graph("callers", name, limit, 50)

    def callees(self, name: str, limit: int = G.GRAPH_LIMIT) -> dict[str, Any]:
        return self._graph("callees", name, limit, 50)

    def _graph(self, what: str, name: str, limit: int, most: int) -> dict[str, Any]:
        if not name.strip() or len(name) > 200:
            return failure("INVALID_INPUT", "symbol: 1 to 200 characters are expected")
        try:
            check_limit(limit, most)
        except InvalidInput as error:
            return failure("INVALID_INPUT", str(error))
        ready = self._ready("auto-index-light")
        if not ready["ok"]:
            return ready
        t = self.store.tables()
        if what == "symbol":
            return {"ok": True, "hits": _rows(G.lookup(t["symbols"], t["files"], name, limit))}
        found = G.callers if what == "callers" else G.callees
        selector = parse_selector(name)
        matched = candidates(place(t["symbols"], t["files"]), selector, G.MATCHED_LIMIT)
        shown = matched.select(F.col("path").alias("file_path"), F.col("name").alias("symbol_name"), "kind", "start_line", "end_line", "exported", F.col("parent_name").alias("parent_symbol_name"))
        return {"ok": True, "symbol_name": name, "matched_symbols": _rows(shown), "hits": _rows(found(t["symbols"], t["files"], t["relations"], selector, limit))}

    # -- health -----------------------------------------------------------

    def status(self) -> dict[str, Any]:
        base = {"ok": True, "root": self.root, "config_path": config_path(self.root), "index_path": self.store.folder}
        if not os.path.exists(config_path(self.root)) or not self.store.exists():
            return base | {"initialized": False, "freshness": "stale", "counts": dict.fromkeys(COUNTED, 0), "pending": {"added": 0, "changed": 0, "removed": 0}}
        pending = self.pending()
        counts = {name: self.store.table(name).count() for name in COUNTED}
        return base | {"initialized": True, "freshness": pending.pop("freshness"), "pending": pending, "counts": counts, "last_indexed_at": self.store.metadata("last_indexed_at")}

    def doctor(self) -> dict[str, Any]:
        """Named checks and whether all of them hold."""
        checks: list[tuple[str, bool, str]] = []
        folder = os.path.join(self.root, INDEX_FOLDER)
        checks.append(("index-folder", os.path.isdir(folder), folder))
        there = os.path.exists(config_path(self.root))
        checks.append(("config-present", there, config_path(self.root)))
        if there:
            try:
                config = load_config(self.root)
                checks.append(("config-valid", True, f"{len(config['include'])} include and {len(config['exclude'])} exclude patterns"))
            except ValueError as error:
                checks.append(("config-valid", False, str(error)))
                return self._report(checks)
        checks.append(("snapshot-open", self.store.exists(), self.store.folder))
        status = self.status()
        if status["initialized"]:
            version, counts, pending = self.store.metadata("schema_version"), status["counts"], status["pending"]
            checks.append(("schema-version", bool(version), f"schema_version={version}"))
            checks.append(("index-content", all(counts[n] > 0 for n in ("files", "symbols", "chunks")), ", ".join(f"{k}={v}" for k, v in counts.items())))
            checks.append(("index-fresh", status["freshness"] == "fresh", ", ".join(f"{k}={v}" for k, v in pending.items())))
            checks.append(("last-indexed-at", bool(status["last_indexed_at"]), str(status["last_indexed_at"])))
        else:
            checks.append(("index-content", False, "the repository is not initialized"))
        return self._report(checks)

    def _report(self, checks: list[tuple[str, bool, str]]) -> dict[str, Any]:
        return {
            "ok": True,
            "root": self.root,
            "summary": "healthy" if all(ok for _, ok, _ in checks) else "warning",
            "checks": [{"name": name, "ok": ok, "details": details} for name, ok, details in checks],
        }


