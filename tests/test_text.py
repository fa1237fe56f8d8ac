import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeatlas.functions import text as T
from codeatlas.functions.porter import stem
from codeatlas.functions.vectors import cosine, hashed_embedding
from codeatlas.operators.selector import Selector, parse_selector
from codeatlas.operators.symbols import parse_selectors
from codeatlas.sources.tree import DEFAULT_EXCLUDE, glob_regex


def test_tokens_and_plans():
    assert T.query_tokens("Where is_it  a B2-c?") == ["where", "is_it", "b2"]
    assert T.expanded_tokens(["handlers", "auth"]) == ["handlers", "handler", "auth", "authentication", "token"]
    assert T.text_plans("??") == [T.TextPlan(("??",), "phrase")]
    assert [p.mode for p in T.text_plans("tool box")] == ["and", "or"]
    assert len(T.text_plans("tool")) == 1


def test_like_keeps_wildcards_and_escapes_backslashes():
    assert T.like_pattern("a_b%\\c") == "%a_b%\\\\c%"


SELECTORS = {
    "run": Selector("run"),
    "Motor.run": Selector("run", "Motor"),
    "src/a.ts#Motor.run": Selector("run", "Motor", "src/a.ts"),
    "src/a.ts#run": Selector("run", None, "src/a.ts"),
    "#run": Selector("#run"),
    "run#": Selector("run#"),
    "src/a.ts": Selector("src/a.ts"),
    ".run": Selector(".run"),
    "a.b.c": Selector("c", "a.b"),
}


@pytest.mark.parametrize("text", SELECTORS)
def test_selector(text):
    assert parse_selector(text) == SELECTORS[text]


def test_selector_columns_agree(spark):
    rows = parse_selectors(spark.createDataFrame([(t, t) for t in SELECTORS], "qid string, selector string")).collect()
    for r in rows:
        s = SELECTORS[r.qid]
        assert (r.symbol, r.container, r.path_hint) == tuple(x.lower() if x else x for x in (s.symbol, s.container, s.path)), r.qid


@pytest.mark.parametrize(
    ("left", "right", "wanted"), [("1.2.3", "1.2.3", 0), ("1.2.4", "1.2.3", 1), ("0.10.0", "0.9.9", 1), ("1.2.3", "1.2.4", -1), ("v1.2", "1.2.0", 0), ("1.x.3", "1.0.3", 0)]
)
def test_versions(spark, left, right, wanted):
    assert spark.range(1).select(T.compare_versions(F.lit(left), F.lit(right))).first()[0] == wanted


def test_globs():
    import re

    match = lambda p, x: re.match(glob_regex(p), x) is not None
    assert match("**/*.ts", "a.ts") and match("**/*.ts", "x/y/.a.ts") and not match("**/*.ts", "a.tsx")
    assert any(match(p, "x/node_modules/y/z.js") for p in DEFAULT_EXCLUDE)
    assert match("src/{a,b}/?.js", "src/b/c.js")


def fts_stem(words):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", enumerate(words))
    return dict(con.execute("SELECT doc, term FROM v"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("abceilnorstuyz", min_size=1, max_size=7), st.sampled_from(["", "ational", "izer", "ement", "ing", "ed", "eed", "ies", "ss", "ly", "ness", "sion", "e", "ll"])), min_size=1, max_size=40))
def test_stemmer_equals_fts5(parts):
    words = [a + b for a, b in parts]
    assert fts_stem(words) == {i: stem(w) for i, w in enumerate(words)}


def fnv(token):
    h = 2166136261
    for c in token:
        h = (h ^ ord(c)) * 16777619 % 2**32
    return h


def test_embedding_and_cosine(spark):
    text = "The tool, the Box"
    row = spark.range(1).select(hashed_embedding(F.lit(text), 16).alias("v"), hashed_embedding(F.lit(""), 16).alias("z")).first()
    counts = [0.0] * 16
    for token in ["the", "tool", "the", "box"]:
        counts[fnv(token) % 16] += 1
    norm = sum(x * x for x in counts) ** 0.5
    assert row.v == [round(x / norm, 8) for x in counts] and row.z == [0.0] * 16
    near = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(cosine(F.col("a"), F.col("b"))).first()[0]
    assert near([3.0, 4.0], [3.0, 4.0, 9.0]) == pytest.approx(1.0) and near([], [1.0]) == 0.0 and near([0.0], [1.0]) == 0.0
