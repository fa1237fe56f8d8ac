"""Listing a tree in rounds, and snapshots that readers still hold."""

import os

import pytest

from codeatlas.shared import shared_dir
from codeatlas.sources.store import IndexStore
from codeatlas.sources.tree import list_tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    """Nested, wide, linked, excluded, odd-named and empty folders."""
    root = tmp_path_factory.mktemp("a tree 100%")
    names = [f"wide/d{i}/x{i}.ts" for i in range(30)] + ["/".join(f"n{i}" for i in range(d)) + "/deep.ts" for d in range(1, 12)]
    names += ["top.ts", ".hidden/h.js", "ünï/é ü.tsx", "node_modules/no.ts", "wide/dist/no.js", "notes.md", "a#b/c d.jsx"]
    for i, name in enumerate(names):
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text("x" * i)
        os.utime(root / name, ns=(10**18 + i * 10**6, 10**18 + i * 10**6))
    os.makedirs(root / "empty")
    os.symlink(root / "wide", root / "empty" / "again")
    os.symlink(root / "top.ts", root / "linked.ts")
    os.symlink(root / "gone.ts", root / "broken.ts")
    return str(root)


def walked(root):
    rows = set()
    for folder, _, files in os.walk(root):
        for name in files:
            path = os.path.relpath(os.path.join(folder, name), root)
            if name.endswith((".ts", ".tsx", ".js", ".jsx")) and not {"node_modules", "dist"} & set(path.split(os.sep)) and os.path.exists(os.path.join(folder, name)):
                state = os.stat(os.path.join(folder, name))
                rows.add((path, state.st_size, state.st_mtime_ns // 10**6))
    return rows


def test_any_budget_lists_the_same(spark, root):
    want = walked(root)
    assert len(want) == 30 + 11 + 4 + 1  # with the linked file
    for budget, rounds in ((1, 12), (15, None), (20_000, 1)):
        into = shared_dir(spark, "tree")
        rows = [(r.path, r.size_bytes, r.mtime_ms) for r in list_tree(spark, root, into=into, budget=budget).collect()]
        assert sorted(rows) == sorted(want), budget
        made = len([d for d in os.listdir(into.removeprefix("file:")) if not d.startswith(".")])
        assert rounds in (None, made) or budget == 1 and made >= 11
    assert {r.path for r in list_tree(spark, f"file://{root}").collect()} == {r[0] for r in want}


def test_a_missing_tree_is_empty(spark, root):
    assert list_tree(spark, f"{root}/not there").count() == 0


def test_a_reader_of_the_last_snapshot_ends(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    store.ensure()
    tables = store.tables()
    first = store.current()
    held = store.table("index_metadata")
    store.write(tables)
    assert store.current() != first and held.count() == 1
    short = IndexStore(spark, str(tmp_path), grace=0)
    short.write(short.tables())
    assert sorted(d for d in os.listdir(short.folder) if d.startswith("snap_")) == ["snap_3"]


def test_a_failed_run_leaves_no_stage(spark, tmp_path, monkeypatch):
    from codeatlas.plans import indexer
    from codeatlas.sources.config import parse_config

    staged = []
    monkeypatch.setattr(indexer, "_refreshed", lambda spark, details, store, *rest: staged.append(store.stage("")) or 1 / 0)
    (tmp_path / "a.ts").write_text("export const a = 1;\n")
    with pytest.raises(ZeroDivisionError):
        indexer.index_repository(spark, str(tmp_path), parse_config({}))
    assert staged and not os.path.exists(staged[0].removeprefix("file:"))
