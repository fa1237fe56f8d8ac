"""Every registered query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

from codeatlas.operators import program as P
from codeatlas.operators import relations as R
from codeatlas.plans import generated
from codeatlas.plans.indexer import build_relations, stored_symbols
from codeatlas.plans.registry import QUERIES, SQL
from codeatlas.sources import virtual
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    wanted = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(wanted.fetchall(), wanted.columns)


def same_on(spark, name, folder):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, wanted = QUERIES[name](spark, folder), connection.sql(SQL[name])
    rows = got.collect()
    assert plain([tuple(r) for r in rows], got.columns) == plain(wanted.fetchall(), wanted.columns)
    return rows


def test_all_references_are_resolved(spark):
    rows = same_on(spark, "resolve_targets", DATA.replace("sf0.001", "sf0.01"))
    assert {r.ref_id % 1000 for r in rows} > set(range(1, 21))


def test_selectors_of_all_parts(spark):
    rows = QUERIES["lookup_batch"](spark, DATA).collect()
    parts = spark.read.parquet(f"{DATA}/part.parquet").selectExpr("concat('Brand_', substring_index(p_brand, '#', -1), '.', p_name) AS s").distinct()
    assert {r.qid for r in rows} == {r.s for r in parts.collect()}


def test_whole_texts_of_all_items_are_asked(spark):
    rows = QUERIES["bm25_batch"](spark, DATA).collect()
    assert {r.qid for r in rows} == {r.item_id for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}


def test_aliases_of_all_suppliers(spark):
    same_on(spark, "alias_closure", DATA.replace("sf0.001", "sf0.01"))


def test_batches_find_what_single_lookups_find(spark):
    """Exact names, parts of names, wildcards, paths and containers, one by one and together."""
    from codeatlas.operators import symbols as G
    from codeatlas.sources.virtual import VirtualIndex

    v = VirtualIndex(spark, DATA)
    symbols, files = v.symbols().persist(), v.symbol_files().persist()
    asked = ["red widget", "widg", "r_d%t", "%", "_", "d", "ed", "Brand_2.widg", "brand/1#widget", "br_nd/1#Brand_12.dget", "BRAND_2", "nothing like it", "a\\b", "Brand_2.red widget"]
    queries = spark.createDataFrame([(i, x) for i, x in enumerate(asked)], "qid long, selector string")
    batch = {}
    for r in G.lookup_batch(symbols, files, queries).collect():
        batch.setdefault(r.qid, []).append((r.nth, r.path, r["name"], r.start_line, r.end_line, r.exported, r.parent_name))
    for i, selector in enumerate(asked):
        single = [(n + 1, r.file_path, r.symbol_name, r.start_line, r.end_line, r.exported, r.parent_symbol_name) for n, r in enumerate(G.lookup(symbols, files, selector).collect())]
        assert sorted(batch.get(i, [])) == single, selector


def test_alias_chains_have_no_depth_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 38), (7, 7)], "name long, target long")
    got = {(r.name, r.reach) for r in R.alias_closure(edges).collect()}
    assert got == {(i, j) for i in range(41) for j in range(41) if i <= j or min(i, j) >= 38}


def test_re_exports_have_no_depth_limit(spark):
    rows = [("m0.ts", 1, "export", "thing", "thing", None, None)]
    rows += [(f"m{i}.ts", 1, "export", "thing", "thing", f"m{i - 1}", "from") for i in range(1, 41)]
    facts = spark.createDataFrame(rows, "path string, ord long, fact string, a string, b string, c string, d string")
    got = {(r.key, r.def_key) for r in P.definitions(facts).collect()}
    assert got == {(f"m{i}", "m0") for i in range(41)}


def test_every_query_without_sql_runs(spark):
    for name in QUERIES.keys() - SQL.keys():
        assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_a_method_name_that_many_classes_share(spark):
    """Selectors with a container meet their own class only; bare ones and wildcards are looked up once."""
    from codeatlas.operators import symbols as G

    n = 5000
    classes = [(i, i, None, f"C{i}", "class", 1, 9, True) for i in range(n)]
    methods = [(n + i, i, i, "get", "method", 2, 3, i % 2 == 0) for i in range(n)]
    symbols = spark.createDataFrame(classes + methods, "id long, file_id long, parent_symbol_id long, name string, kind string, start_line int, end_line int, exported boolean")
    files = spark.createDataFrame([(i, f"src/f{i:04d}.ts") for i in range(n)], "id long, path string")
    wanted = {f"C{i}.get": [n + i] for i in range(n)}
    wanted |= {"get": [n + i for i in range(0, 20, 2)], "f0003.ts#get": [n + 3], "C7.e": [n + 7], "C7.%": [n + 7], "C7._": [n + 7], "nothing": []}
    wanted |= {"%": [i for i in range(10)], "____": [i for i in range(1000, 1010)], "f0042#_": [42, n + 42]}
    queries = spark.createDataFrame([(q, q) for q in wanted] + [("again", "get")], "qid string, selector string")
    found = {}
    for r in G.lookup_batch(symbols, files, queries).orderBy("qid", "nth").collect():
        found.setdefault(r.qid, []).append(r.id)
    assert found.pop("again") == found["get"]
    for name, selector in (("get", "get"), ("%", "%"), ("____", "____"), ("C7._", "C7._"), ("f0042#_", "f0042#_")):
        single = G.lookup(symbols, files, selector).collect()
        paths = [(r.file_path, r.symbol_name) for r in single]
        named = {i: (f"src/f{i % n:04d}.ts", f"C{i}" if i < n else "get") for i in found[name]}
        assert [named[i] for i in found[name]] == paths
    assert found == {q: ids for q, ids in wanted.items() if ids} | {q: found[q] for q in ("%", "____", "f0042#_")}


def test_an_index_follows_its_files(spark):
    """Another table under the same path is read anew."""
    from codeatlas.shared import shared_dir

    folder = shared_dir(spark, "replaced")
    for text in ("one two two", "three"):
        rows = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
        rows.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        terms = {r.term: r.hits for r in QUERIES["postings_stats"](spark, folder).collect()}
        assert {t: n for t, n in terms.items() if t in ("one", "two", "three")} == ({"one": 1, "two": 2} if " " in text else {"three": 1})


def test_symbols_of_the_program_make_no_edges_and_facts_lie_by_their_sort(spark):
    generated._INDEXED.clear()
    assert set(generated.indexed(spark, DATA)) == {"files", "rows"}
    (held,) = generated._INDEXED.values()
    assert "relations" not in held
    parsed = spark.read.schema(held["parsed"][1]).parquet(held["parsed"][0])
    assert all("/fact=import/" in path for path in parsed.where("fact = 'import'").select("_metadata.file_path").distinct().toPandas()["file_path"])
    assert set(generated.indexed(spark, DATA, edges=True)) == {"files", "rows", "relations"}


def test_definitions_are_made_once_for_both_sorts_of_references(spark):
    generated.indexed(spark, DATA)
    (held,) = generated._INDEXED.values()
    parsed, rows, files = (spark.read.schema(held[n][1]).parquet(held[n][0]) for n in ("parsed", "rows", "files"))
    names = []

    def keep(df, name):
        names.append(name)
        return P.in_shared_folder(df, name)

    build_relations(parsed, stored_symbols(rows), files, keep)
    assert [n for n in names if n.endswith("definitions_0")] == ["definitions_0"]


def test_tasks_grow_with_the_files_of_a_table(spark, monkeypatch):
    documents = virtual.VirtualIndex(spark, DATA).table("documents")
    assert virtual.tasks_for(documents) == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(virtual, "TASK_BYTES", 1000)
    assert virtual.tasks_for(documents) > 20


def test_rerank_reads_texts_of_candidates_without_shuffling_the_others(spark):
    plan = QUERIES["rerank_fts"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


@pytest.fixture(scope="module")
def shared_ids(spark, tmp_path_factory):
    """A folder where parts have the ids of classes, so that a method has two parents and an id two symbols."""
    folder = str(tmp_path_factory.mktemp("shared_ids"))
    for table, key in (("part", "p_partkey"), ("lineitem", "l_partkey")):
        rows = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/{table}.parquet")
        rows.withColumn(key, rows[key] + virtual.CLASS_BASE).write.parquet(f"{folder}/{table}.parquet")
    return folder


@pytest.mark.parametrize("partitions", ["2", "7"])
def test_what_rows_show_ends_ties_of_ids_with_two_parents(spark, shared_ids, partitions):
    """``callers_batch`` leaves no tie open: it has the places that its SQL gives when its order is completed."""
    connection = duckdb.connect()
    for table in ("part", "lineitem"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{shared_ids}/{table}.parquet/*.parquet'")
    order = "ORDER BY s.path, s.start_line, s.id)"
    assert SQL["callers_batch"].count(order) == 1
    wanted = connection.sql(SQL["callers_batch"].replace(order, order[:-1] + ", s.kind, s.name, s.parent_name NULLS FIRST)"))
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = QUERIES["callers_batch"](spark, shared_ids)
        rows = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert plain(rows, got.columns) == plain(wanted.fetchall(), wanted.columns)
    # Every row has its twin: the same place in the file below another parent.
    assert {r[got.columns.index("parent_name")].startswith("Brand_") for r in rows if r[got.columns.index("kind")] == "method"} == {True, False}
