"""The jobs: against their SQL, over growing input, and from the command line's settings."""

import json

import duckdb
import pytest

from codeatlas.operators import search as S
from codeatlas.functions import text as T
from codeatlas.shared import shared_dir
from jobs import call_report, refresh_search_index
from jobs import queries as jobs
from jobs.settings import settings
from tests.conftest import DATA
from tests.test_queries import TABLES, plain

DOCUMENT = "doc_id long, text string, lang string, source string, extra string, batch string"


@pytest.mark.parametrize("name", sorted(jobs.SQL))
def test_job_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, wanted = jobs.QUERIES[name](spark, DATA), connection.sql(jobs.SQL[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(wanted.fetchall(), wanted.columns)


def add_file(spark, folder, rows):
    spark.createDataFrame([(*r, "x", "y") for r in rows], DOCUMENT).coalesce(1).write.mode("append").parquet(folder)


def held(spark, output):
    postings, lengths = refresh_search_index.current(spark, output)
    return (
        sorted((r.chunk_id, r.term, tuple(r.positions), r.language) for r in postings.where("col = 'content'").collect()),
        {r.chunk_id: r.length for r in lengths.collect()},
    )


def files(spark, output):
    return {(r.file, r.time, r.size) for r in refresh_search_index.table(spark, output, "postings").selectExpr("_metadata.file_path AS file", "_metadata.file_modification_time AS time", "_metadata.file_size AS size").distinct().collect()}


def test_index_follows_growing_input(spark):
    folder = shared_dir(spark, "growing")
    documents, output, checkpoint = f"{folder}/documents", f"{folder}/index", f"{folder}/checkpoint"
    run = lambda: refresh_search_index.refresh(spark, documents, output, checkpoint)
    first = [(1, "one Two two", "en", "a"), (2, None, None, "a"), (3, "", "", None), (None, "nobody", "en", "a"), (4, "vier", "de", "b"), (4, "vier vier", "de", "b"), (4, "vier vier", "de", "b")]
    add_file(spark, documents, first)
    assert run() == {"batches": 1, "read": 7, "without_id": 1, "indexed": 4, "postings": 2 + 1 + 5 + 5 + 4 + 5}
    postings, lengths = held(spark, output)
    assert postings == [(1, "one", (0,), "en"), (1, "two", (1, 2), "en"), (4, "vier", (0, 1), "de")]
    assert lengths == {1: 3 + 5, 2: 5, 3: 4, 4: 2 + 5}

    # Only the new file is read: one new document, one changed, one as it was.
    seen = files(spark, output)
    add_file(spark, documents, [(5, "five", "en", "a"), (1, "one more", "en", "a"), (4, "vier vier", "de", "b")])
    counts = run()
    assert (counts["batches"], counts["read"], counts["indexed"]) == (1, 3, 2)
    postings, lengths = held(spark, output)
    assert postings == [(1, "more", (1,), "en"), (1, "one", (0,), "en"), (4, "vier", (0, 1), "de"), (5, "five", (0,), "en")]
    assert seen < files(spark, output)

    # Nothing new: nothing is written.
    seen = files(spark, output)
    assert run() == {"batches": 0, "read": 0, "without_id": 0, "indexed": 0, "postings": 0}
    assert files(spark, output) == seen and held(spark, output) == (postings, lengths)

    # The library searches the index as it stands.
    index, sizes = refresh_search_index.current(spark, output)
    found = S.bm25(index, sizes, T.TextPlan(("one", "vie"), "or"))
    assert {r.chunk_id for r in found.collect()} == {1, 4}


def test_growing_input_equals_all_at_once(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    folder = shared_dir(spark, "halves")
    for part in (rows[:80], rows[80:]):
        add_file(spark, f"{folder}/documents", [tuple(r) for r in part])
        refresh_search_index.refresh(spark, f"{folder}/documents", f"{folder}/index", f"{folder}/checkpoint")
    refresh_search_index.refresh(spark, f"{folder}/documents", f"{folder}/whole", f"{folder}/other")
    assert held(spark, f"{folder}/index") == held(spark, f"{folder}/whole")


def test_a_batch_that_is_tried_again_gives_the_same_rows(spark):
    output = shared_dir(spark, "again")
    rows = spark.createDataFrame([(1, "one two", "en", "a"), (2, "two", "en", "a")], refresh_search_index.DOCUMENTS)
    more = spark.createDataFrame([(1, "three", "en", "a")], refresh_search_index.DOCUMENTS)
    refresh_search_index.index_batch(rows, 0, output)
    refresh_search_index.index_batch(more, 1, output)
    once = held(spark, output)
    refresh_search_index.index_batch(more, 1, output)
    assert held(spark, output) == once
    with pytest.raises(ValueError, match="another checkpoint"):
        refresh_search_index.index_batch(rows, 0, output)


def test_no_documents(spark):
    folder = shared_dir(spark, "none")
    spark.createDataFrame([], DOCUMENT).write.parquet(f"{folder}/documents")
    refresh_search_index.refresh(spark, f"{folder}/documents", f"{folder}/index", f"{folder}/checkpoint")
    assert held(spark, f"{folder}/index") == ([], {})


def test_roles(spark):
    symbols = spark.createDataFrame(
        [(i, f, None, f"s{i}", "function", i, i + 1, e) for i, f, e in [(1, 10, True), (2, 10, False), (3, 20, True), (4, 20, False), (5, 20, False), (6, 20, True)]],
        "id long, file_id long, parent_symbol_id long, name string, kind string, start_line int, end_line int, exported boolean",
    )
    paths = spark.createDataFrame([(10, "a.ts"), (20, "b.ts")], "id long, path string")
    edges = spark.createDataFrame([(1, 2), (2, 4), (1, 4), (4, 2), (5, 5), (2, 3), (2, 3)], "source_symbol_id long, target_symbol_id long")
    rows = {r.id: r for r in call_report.call_report(symbols, paths, edges, 2).collect()}
    assert {i: r.role for i, r in rows.items()} == {1: "entry", 2: "shared", 3: "leaf", 4: "hub", 5: "unused", 6: "entry"}
    assert (rows[4].callers, rows[4].outside_callers, rows[4].callees, rows[4].first_caller) == (2, 2, 1, "s1")
    assert (rows[5].callers, rows[5].recursive, rows[5].first_caller) == (0, True, None)
    assert rows[3].callers == 1


def test_report_is_replaced(spark):
    output = shared_dir(spark, "report")
    first = call_report.report(spark, DATA, output, 1)
    again = call_report.report(spark, DATA, output, 10**9)
    assert "hub" in first and "hub" not in again and sum(first.values()) == sum(again.values())


def test_settings(tmp_path, capsys):
    path = tmp_path / "job.json"
    path.write_text(json.dumps({"tables": "a", "output": "b", "hub_callers": 3}))
    assert settings(str(path), call_report.NAMES, ["--output", "c", "--hub-callers", "4"]) == {"tables": "a", "output": "c", "hub_callers": 4}
    for bad in ({"tables": "a", "output": "b"}, {"tables": "a", "output": "b", "hub_callers": "3"}, {"tables": "a", "output": "b", "hub_callers": 3, "more": 1}):
        path.write_text(json.dumps(bad))
        with pytest.raises(SystemExit):
            settings(str(path), call_report.NAMES, [])
    for job in ("call_report", "refresh_search_index"):
        names = {"call_report": call_report, "refresh_search_index": refresh_search_index}[job].NAMES
        assert set(settings(f"jobs/{job}.json", names, [])) == set(names)
