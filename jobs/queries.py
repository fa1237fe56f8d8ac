"""The jobs as registered queries: each runs twice into one new folder and returns what is there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeatlas.functions.analyzer import NOT_WORD
from codeatlas.plans.registry import with_views
from codeatlas.shared import shared_dir
from jobs.call_report import report, written
from jobs.refresh_search_index import current, refresh

HUB_CALLERS = 25


def job1_refresh_search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "job1")
    for _ in range(2):
        refresh(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    postings, _ = current(spark, f"{folder}/index")
    return postings.select(F.col("chunk_id").alias("doc_id"), F.col("col").alias("field"), "term", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "language")


def job2_call_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "job2")
    for _ in range(2):
        report(spark, sf_dir, f"{folder}/report", HUB_CALLERS)
    return written(spark, f"{folder}/report")


QUERIES = {"job1_refresh_search_index": job1_refresh_search_index, "job2_call_report": job2_call_report}

SQL = {
    "job1_refresh_search_index": f"""
WITH named AS (
    SELECT doc_id, coalesce(text, '') AS text, text AS content, coalesce(nullif(lang, ''), 'unknown') AS language,
           coalesce(source, '') || '/' || coalesce(nullif(lang, ''), 'unknown') || '/doc_' || doc_id || '.txt' AS path
    FROM documents WHERE doc_id IS NOT NULL),
docs AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, sha1(path || chr(10) || text) DESC) AS n FROM named) WHERE n = 1),
fields AS (
    SELECT doc_id, language, 'content' AS field, content AS x FROM docs WHERE content IS NOT NULL
    UNION ALL SELECT doc_id, language, 'file_path', path FROM docs),
tokens AS (
    SELECT doc_id, language, field, list_filter(regexp_split_to_array(strip_accents(lower(x)), '{NOT_WORD}'), lambda t: length(t) > 0) AS t FROM fields),
each_ AS (SELECT doc_id, language, field, unnest(t) AS term, unnest(range(0, len(t))) AS place FROM tokens)
SELECT doc_id, field, term, string_agg(place::VARCHAR, ',' ORDER BY place) AS positions, language FROM each_ GROUP BY doc_id, language, field, term
""",
    "job2_call_report": with_views(f"""
edges AS (SELECT DISTINCT source_symbol_id AS s, target_symbol_id AS t FROM vrelations),
met AS (
    SELECT e.t AS id, c.path, c.start_line, c.id AS caller, c.name, c.file_id <> d.file_id AS outside
    FROM edges e JOIN vplaced c ON c.id = e.s JOIN vplaced d ON d.id = e.t WHERE e.s <> e.t),
firsts AS (SELECT id, name, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path, start_line, caller) AS n FROM met) WHERE n = 1),
called AS (SELECT id, count(*) AS callers, count(*) FILTER (outside) AS outside_callers FROM met GROUP BY id),
calls AS (SELECT s AS id, count(*) FILTER (s <> t) AS callees, bool_or(s = t) AS recursive FROM edges GROUP BY s)
SELECT p.id, p.path, p.parent_name, p.name, p.kind, p.start_line, p.exported, coalesce(callers, 0) AS callers, coalesce(outside_callers, 0) AS outside_callers,
       coalesce(callees, 0) AS callees, coalesce(recursive, false) AS recursive, f.name AS first_caller, f.path AS first_caller_path,
       CASE WHEN coalesce(outside_callers, 0) >= {HUB_CALLERS} THEN 'hub' WHEN callers > 0 AND callees > 0 THEN 'shared' WHEN callers > 0 THEN 'leaf'
            WHEN p.exported THEN 'entry' ELSE 'unused' END AS role
FROM vplaced p LEFT JOIN called USING (id) LEFT JOIN calls USING (id) LEFT JOIN firsts f USING (id)
"""),
}
