"""The stored index of names: what it finds, and what it reads."""

import random

import pytest

from codeatlas.functions.text import contains_like
from codeatlas.operators import symbols as G
from codeatlas.operators.names import build_name_index, contained
from codeatlas.sources.virtual import VirtualIndex
from tests.conftest import DATA
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def names():
    draw = random.Random(3)
    some = {"".join(draw.choice("abcAB_%é") for _ in range(draw.randint(1, 9))) for _ in range(400)}
    return sorted(some | {"", "a", "ab", "back\\slash", "a%b", "a_b", "x" * 5000, "ÉCLAIR", "éclair"})


@pytest.fixture(scope="module")
def index(spark, names):
    rows = [(i, n, None, "p", i) for i, n in enumerate(names)] + [(9000, None, None, "p", 1), (9001, "a", None, "q", 2)]
    return build_name_index(spark.createDataFrame(rows, "id long, name string, parent_name string, path string, start_line long"))


TERMS = ["a", "ab", "abca", "b_a", "a%b%c", "ab%bc", "k\\s", "écl", "xxxx", "zzz", "%ca%"]


def test_names_equal_a_scan(spark, index, names):
    """Wildcards, short terms, absent substrings and backslashes, one by one and in a table."""
    scan = spark.createDataFrame([(n.translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}),) for n in names], "folded string").distinct()
    want = {t: sorted(r.folded for r in scan.where(contains_like(F.col("folded"), t)).collect()) for t in TERMS}
    assert {t: sorted(r.folded for r in index.like(t).collect()) for t in TERMS} == want
    assert want["ab"] and want["a%b%c"] and want["k\\s"] and not want["zzz"]
    terms = spark.createDataFrame([(t,) for t in TERMS], "symbol string")
    pairs = sorted((t, n) for t, found in want.items() for n in found)
    assert sorted(tuple(r) for r in index.contained(terms).collect()) == pairs
    assert sorted(tuple(r) for r in contained(scan, terms).collect()) == pairs


def test_symbols_of_a_name(index):
    assert sorted(r.id for r in index.symbols_like("x%x").collect()) == [r.id for r in index.placed.where("folded like 'xx%'").collect()]
    assert 9001 in {r.id for r in index.symbols_like("a").collect()}
    everything = {r.id for r in index.symbols_like("%").collect()}
    assert 9001 in everything and 9000 not in everything  # no name, not found by one


def test_an_index_of_nothing(spark):
    empty = build_name_index(spark.createDataFrame([], "id long, name string, parent_name string, path string, start_line long"))
    assert empty.like("ab").count() == 0 and empty.symbols_like("%").count() == 0


def test_lookups_read_one_list(spark):
    """Same rows as a scan; folders and row groups of one substring, then folders of the names that were found."""
    v = VirtualIndex(spark, DATA)
    symbols, files = v.symbols().persist(), v.symbol_files().persist()
    index = build_name_index(G.place(symbols, files))
    for selector in ["widg", "r_d%t", "red widget", "Brand_12.dget", "br_nd/1#Brand_12.dget", "d", "_", "nothing like it"]:
        assert G.lookup_stored(index, selector).collect() == G.lookup(symbols, files, selector).collect(), selector
    plan = index.like("widg")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram," in plan
    found = index.symbols_like("widg")
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(["widg", "r_d%t", "Brand_2.widg", "d", "%", "nothing"])], "qid long, selector string")
    rows = lambda **more: sorted((r.qid, r.nth, r.id) for r in G.lookup_batch(symbols, files, queries, **more).collect())
    assert rows(index=index) == rows()
