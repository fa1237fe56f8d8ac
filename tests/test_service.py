"""A small repository from first index to refresh, through the service."""

import json
import os
import shutil

import pytest

from codeatlas.plans.service import CodeAtlas
from codeatlas.sources.config import InvalidInput, check_query, config_path, find_root, parse_config

#: One rule of the call graph to a file, on watering a greenhouse.
FILES = {
    # Same name in two files, one of them private; an arrow function beside a plain one.
    "journal.ts": "export function log(line: string) {\n  return line.length;\n}\n\nexport const quiet = (line: string) => log(line.trim());\n",
    "valve.ts": "function log() {}\n\nexport default class Valve {\n  drain() {\n    log();\n    return this.open();\n  }\n\n  open() {\n    return 5;\n  }\n}\n",
    # Re-exports under other names, a default one too.
    "index.ts": "export { default as Tap } from './valve';\nexport { log as record } from './journal';\n",
    "plans/evening.ts": "import { log as note } from '../journal';\n\nexport function evening() {\n  const scribble = note;\n  scribble('dusk');\n}\n",
    "plans/morning.ts": "import Gate from '../valve';\n\nexport function morning() {\n  const gate = new Gate();\n  gate.drain();\n}\n",
    "plans/night.ts": "import { record } from '..';\n\nexport function night() {\n  record('stars');\n}\n",
    "plans/noon.ts": "import * as journal from '../journal';\n\nexport const noon = () => journal.quiet('sun');\n",
    # One method name in two classes, told apart by the declared types of members.
    "probes.ts": "export class AirProbe {\n  sample() {\n    return 20;\n  }\n}\n\nexport class SoilProbe {\n  sample() {\n    return 0.3;\n  }\n}\n",
    "station.ts": "import { AirProbe, SoilProbe } from './probes';\n\ninterface Bench {\n  air: AirProbe;\n  soil: SoilProbe;\n}\n\nexport class Climate {\n  constructor(private bench: Bench) {}\n\n  warm() {\n    return this.bench.air.sample() > 25;\n  }\n}\n\nexport const wet = (bench: Bench) => bench.soil.sample() > 0.5;\n",
}


def put(root, name, text):
    with open(os.path.join(root, "src", name), "w", encoding="utf-8") as file:
        file.write(text)


@pytest.fixture(scope="module")
def atlas(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("repo"))
    os.makedirs(f"{root}/src/plans")
    with open(f"{root}/package.json", "w", encoding="utf-8") as file:
        file.write("{}")
    for name, text in FILES.items():
        put(root, name, text)
    atlas = CodeAtlas(spark, root)
    assert atlas.query("log")["error"]["code"] == "REPO_NOT_INITIALIZED"
    assert atlas.doctor()["summary"] == "warning"
    assert atlas.init()["already_initialized"] is False and atlas.init()["already_initialized"] is True
    with open(config_path(root), encoding="utf-8") as file:
        config = json.load(file)
    config["embeddings"] |= {"enabled": True, "provider": "mock", "model": "mock-1", "dimensions": 64}
    with open(config_path(root), "w", encoding="utf-8") as file:
        json.dump(config, file)
    result = atlas.index()
    assert {k: result[k] for k in ("ok", "scanned", "inserted", "updated", "removed")} == {"ok": True, "scanned": 9, "inserted": 9, "updated": 0, "removed": 0}
    assert result["symbols"] == result["chunks"] == 21
    return atlas


def names(result, side):
    return [h[f"{side}_symbol_name"] for h in result["hits"]]


def test_lookup(atlas):
    hits = atlas.symbol("log")["hits"]
    assert [(h["file_path"], h["exported"]) for h in hits] == [("src/journal.ts", True), ("src/valve.ts", False)]
    assert [h["parent_symbol_name"] for h in atlas.symbol("sample")["hits"]] == ["AirProbe", "SoilProbe"]
    assert [h["symbol_name"] for h in atlas.symbol("plans/n#n")["hits"]] == ["night", "noon"]
    assert atlas.symbol("")["error"]["code"] == "INVALID_INPUT"


def test_callers(atlas):
    called = lambda selector: set(names(atlas.callers(selector), "caller"))
    assert called("src/journal.ts#log") == {"quiet", "evening", "record", "night"}  # directly, by alias, re-export and barrel
    assert called("src/valve.ts#log") == {"drain"}
    assert called("quiet") == {"noon"}  # by namespace
    assert called("Valve.drain") == {"morning"} and called("Valve.open") == {"drain"}  # by default import, and this
    assert called("Valve") == {"morning"}  # a re-exported default has no name that could be followed
    assert called("src/probes.ts#SoilProbe.sample") == {"wet"} and called("AirProbe.sample") == {"warm"}
    assert len(atlas.callers("src/probes.ts#AirProbe.sample")["matched_symbols"]) == 1 and len(atlas.callers("sample")["matched_symbols"]) == 2


def test_callees(atlas):
    called = lambda selector: set(names(atlas.callees(selector), "callee"))
    assert called("morning") == {"Valve", "drain"}
    assert called("night") == {"record", "log"}
    assert called("src/plans/noon.ts#noon") == {"quiet"}
    assert called("Climate.warm") == called("wet") == {"sample"}
    assert [h["callee_parent_symbol_name"] for h in atlas.callees("wet")["hits"]] == ["SoilProbe"]


def test_search(atlas):
    exact = atlas.query("Evening")
    assert exact["route"] == "symbol" and exact["hits"][0]["score"] == 200 and exact["hits"][0]["symbol_name"] == "evening"
    near = atlas.query("bench soil")
    assert near["route"] == "hybrid" and "src/station.ts" in {h["file_path"] for h in near["hits"]} and "embedding similarity" in near["hits"][0]["rationale"]
    assert atlas.query("x")["error"]["code"] == "INVALID_INPUT" and atlas.query("log", 21)["error"]["code"] == "INVALID_INPUT"


def test_server(atlas):
    import io

    from codeatlas.plans.server import serve

    asked = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "find_callees", "arguments": {"symbol": "wet"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "search_code", "arguments": {"query": "x"}}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "nope"}},
    ]
    sink = io.StringIO()
    serve(atlas, io.StringIO("\n".join([*map(json.dumps, asked), "{"])), sink)
    replies = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4, 5, None]
    assert [t["name"] for t in replies[1]["result"]["tools"]] == ["search_code", "get_symbol", "find_callers", "find_callees"]
    assert replies[2]["result"]["structuredContent"]["hits"][0]["callee_symbol_name"] == "sample" and "SoilProbe.sample" in replies[2]["result"]["content"][0]["text"]
    assert replies[3]["result"]["isError"] and replies[4]["error"]["code"] == -32602 and replies[5]["error"]["code"] == -32700


def test_status_and_doctor(atlas):
    status = atlas.status()
    assert status["freshness"] == "fresh" and status["counts"]["files"] == 9 and status["counts"]["relations"] >= 10
    assert atlas.doctor()["summary"] == "healthy"


def test_refresh(atlas):
    before = {r.path: r.id for r in atlas.store.table("files").collect()}
    os.remove(os.path.join(atlas.root, "src", "station.ts"))
    put(atlas.root, "journal.ts", FILES["journal.ts"] + "\nexport function erase() {\n  return log('');\n}\n")
    put(atlas.root, "reset.ts", "export const reset = () => erase();\n")
    assert atlas.query("extra words", policy="fail")["error"]["code"] == "INDEX_STALE"
    assert atlas.query("extra words", policy="warn")["stale"] is True
    assert atlas.doctor()["summary"] == "warning"
    result = atlas.index()
    assert {k: result[k] for k in ("scanned", "inserted", "updated", "removed")} == {"scanned": 2, "inserted": 1, "updated": 1, "removed": 1}
    after = {r.path: r.id for r in atlas.store.table("files").collect()}
    assert "src/station.ts" not in after and all(before[p] == i for p, i in after.items() if p in before)
    assert names(atlas.callers("erase"), "caller") == ["reset"] and names(atlas.callees("erase"), "callee") == ["log"]
    t = atlas.store.tables()
    chunks = {r.id for r in t["chunks"].collect()}
    assert {r.chunk_id for r in t["postings"].select("chunk_id").distinct().collect()} == chunks == {r.chunk_id for r in t["chunk_embeddings"].collect()}
    # A touched file changes nothing but its row.
    os.utime(os.path.join(atlas.root, "src", "probes.ts"), (1, 1))
    result = atlas.index()
    assert (result["scanned"], result["updated"], result["symbols"]) == (0, 1, 0)
    assert atlas.index() == {"ok": True, "scanned": 0, "inserted": 0, "updated": 0, "removed": 0, "symbols": 0, "relations": 0, "chunks": 0}


def test_edges_after_changes_equal_those_of_a_new_index(spark, tmp_path):
    """Names that come, go and move, barrels, types by inference: the refreshed index has the edges of a rebuilt one."""
    root = str(tmp_path / "repo")
    os.makedirs(f"{root}/src")
    (tmp_path / "repo" / "package.json").write_text("{}")
    first = {
        "make.ts": "export class Pump { push() { return 1; } }\nexport function make() { return new Pump(); }\n",
        "barrel.ts": "export { make as build } from './make';\n",
        "user.ts": "import { build } from './barrel';\nexport function run() { build().push(); }\n",
        "plain.ts": "export function lone() { helper(); }\nfunction own() { return 2; }\nexport function uses() { own(); }\n",
        "zz.ts": "export function helper() { return 3; }\n",
        "still.ts": "function calm() { return quiet(); }\nfunction quiet() { return 1; }\n",
    }
    steps = [
        {"make.ts": "export class Pump { push() { return 1; } }\nexport class Fan { push() { return 2; } }\nexport function make() { return new Fan(); }\n", "aa.ts": "export function helper() { return 4; }\n"},
        {"aa.ts": None, "zz.ts": None, "barrel.ts": "export { make as build } from './other';\n", "other.ts": "import { Pump } from './make';\nexport const make = () => new Pump();\n"},
    ]

    def edges(store):
        t = store.tables()
        placed = t["symbols"].join(t["files"].selectExpr("id AS file_id", "path"), "file_id").selectExpr("id", "concat(path, '#', name, ':', start_line) AS place")
        rows = t["relations"].join(placed.selectExpr("id AS source_symbol_id", "place AS a"), "source_symbol_id").join(placed.selectExpr("id AS target_symbol_id", "place AS b"), "target_symbol_id")
        assert rows.count() == t["relations"].count() == t["relations"].select("id").distinct().count()
        return sorted((r.a, r.b) for r in rows.collect())

    for name, text in first.items():
        put(root, name, text)
    atlas = CodeAtlas(spark, root)
    atlas.init()
    atlas.index()
    kept = {(r.id, r.source_symbol_id, r.target_symbol_id) for r in atlas.store.table("relations").collect()}
    assert ("src/user.ts#run:2", "src/make.ts#push:1") in edges(atlas.store)
    for n, step in enumerate(steps):
        for name, text in step.items():
            os.remove(f"{root}/src/{name}") if text is None else put(root, name, text)
        atlas.index()
        got = edges(atlas.store)
        if n == 0:  # a new helper takes the call over; what has nothing to do with it keeps its edge
            assert ("src/plain.ts#lone:1", "src/aa.ts#helper:1") in got
            now = {(r.id, r.source_symbol_id, r.target_symbol_id) for r in atlas.store.table("relations").collect()}
            assert len(kept & now) >= 1
    other = str(tmp_path / "again")
    shutil.copytree(f"{root}/src", f"{other}/src")
    (tmp_path / "again" / "package.json").write_text("{}")
    fresh = CodeAtlas(spark, other)
    fresh.init()
    fresh.index()
    assert got == edges(fresh.store)


def test_watch(atlas, tmp_path):
    from codeatlas.streaming.watch import watch

    put(atlas.root, "late.ts", "export function late() {\n  return 3;\n}\n")
    watch(atlas, str(tmp_path / "state"), once=True).awaitTermination()
    assert atlas.status()["freshness"] == "fresh" and len(atlas.symbol("late")["hits"]) == 1
    # A file that goes is noticed although no other one changes.
    os.remove(os.path.join(atlas.root, "src", "late.ts"))
    watch(atlas, str(tmp_path / "state"), once=True).awaitTermination()
    assert "src/late.ts" not in {r.path for r in atlas.store.table("files").collect()}


def test_config():
    config = parse_config({"include": ["src/**/*.ts", "src/**/*.tsx", "src/**/*.js", "src/**/*.jsx"], "exclude": ["dist/**", "mine/**"], "chunking": {"maxLines": 5}})
    assert config["include"][0] == "**/*.ts" and config["exclude"].count("**/dist/**") == 1 and "mine/**" in config["exclude"] and config["chunking"]["maxTokens"] == 800
    for bad in ({"retrieval": {"graphExpansionDepth": 4}}, {"chunking": {"maxLines": 0}}, {"git": 3}):
        with pytest.raises(InvalidInput):
            parse_config(bad)
    assert check_query("  ab ", 20) == ("ab", 20)


def test_root(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "package.json").write_text("{}")
    (tmp_path / "a" / "package.json").write_text("{}")
    assert find_root(str(tmp_path / "a" / "b")) == str(tmp_path)
    (tmp_path / "a" / ".git").mkdir()
    assert find_root(str(tmp_path / "a" / "b")) == str(tmp_path / "a")
