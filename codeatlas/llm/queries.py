"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm import bpe, exact_dedup, media, near_dedup, packing, prefix_trie, secrets, substring_dedup, suffix_dedup, toxicity, url_filter, warc
from codeatlas.llm.common import read_table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents")).drop("file", "row")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(read_table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.to_media(read_table(spark, sf_dir, "documents")))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of a line, and passages of repeated sentences inside other lines."""
    return substring_dedup.repeated_passages(read_table(spark, sf_dir, "documents")).drop("row")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removal_digests(suffix_dedup.without_repeats(read_table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(read_table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_near_dedup": op3_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_media": op8_media,
    "op9_url_filter": op9_url_filter,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_prefix_trie": op12_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS size,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id)
""",
    "op3_near_dedup": r"""
WITH RECURSIVE t AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents),
sh AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM t),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
r(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, ways.v FROM r JOIN ways ON ways.u = r.c)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, r.id = min(r.c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
""",
    # Keys and places in the merged index for URLs of a scheme, a host and what follows it, without user and port.
    "op6_warc": r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '^[A-Za-z]+://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS u FROM pages),
keys AS (
    SELECT page_id, lower(array_to_string(list_reverse(string_split(u.host, '.')), ',') || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END
                          || CASE WHEN length(u.query) > 1 THEN u.query ELSE '' END) AS url_key FROM u),
places AS (SELECT page_id, url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS position FROM keys),
p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
c AS (SELECT payload_digest, max(page_id) AS carrier FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> carrier THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> carrier THEN carrier END AS refers_to, url_key, position
FROM p JOIN places USING (page_id) LEFT JOIN c ON p.payload_bytes >= 1000 AND p.payload_digest = c.payload_digest
""",
    # For texts whose white space is ASCII and that don't hold the character U+0001.
    "op10_substring_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS base FROM lines),
cut AS (
    SELECT doc_id, k, base, unnest(p) AS piece, unnest(range(1, len(p) + 1)) AS j
    FROM (SELECT *, string_split(regexp_replace(line, '([.!?]+)(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM placed)),
ended AS (SELECT *, base + sum(length(piece)) OVER (PARTITION BY doc_id, k ORDER BY j) AS stop FROM cut),
normed AS (
    SELECT doc_id, k, j, stop - length(ltrim(piece, E' \t\n\r\f' || chr(11))) AS start, stop,
           trim(regexp_replace(lower(piece), '\s+', ' ', 'g'), E' \t\r\f.,;:!?"''()[]{}*#$%&' || chr(11)) AS normal
    FROM ended),
sentences AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS unit, count(*) OVER (PARTITION BY doc_id, k) AS parts FROM normed WHERE normal <> ''),
wholes AS (
    SELECT doc_id, k, base + length(line) - length(ltrim(line, E' \t\n\r\f' || chr(11))) AS start,
           trim(regexp_replace(lower(line), '\s+', ' ', 'g'), E' \t\r\f.,;:!?"''()[]{}*#$%&' || chr(11)) AS normal
    FROM placed SEMI JOIN (SELECT DISTINCT doc_id, k FROM sentences WHERE parts > 1) USING (doc_id, k)),
firsts AS (
    SELECT normal, min({'d': doc_id, 's': start}) AS f, count(*) AS copies
    FROM (SELECT doc_id, start, normal FROM sentences UNION ALL SELECT doc_id, start, normal FROM wholes) GROUP BY normal HAVING count(*) > 1),
gone AS (SELECT doc_id, k FROM wholes JOIN firsts USING (normal) WHERE doc_id <> f.d OR start <> f.s),
later AS (
    SELECT s.doc_id, s.start, stop, unit, len(string_split(s.normal, ' ')) AS words, copies, f, parts = 1 OR g.k IS NOT NULL AS whole,
           unit - row_number() OVER (PARTITION BY s.doc_id ORDER BY unit) AS near
    FROM sentences s JOIN firsts USING (normal) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.k = s.k WHERE s.doc_id <> f.d OR s.start <> f.s),
summed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, near) AS together FROM later),
runs AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM summed WHERE whole OR together >= 25)
SELECT doc_id, CAST(min(start) AS INT) AS start, CAST(max(stop) AS INT) AS "end", CAST(sum(words) AS BIGINT) AS n_words, count(*) AS n_units,
       max(copies) AS copies, arg_min(f.d, start) AS keep_doc_id, CAST(arg_min(f.s, start) AS INT) AS keep_start, bool_and(whole) AS whole_lines
FROM runs GROUP BY doc_id, run
""",
    # The CRC-32 of the decimal id, a bit at a time.
    "op12_prefix_trie": r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
crc AS (
    SELECT *, conv_id - conv_id % 100 AS base,
           xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END) END)) % 6 AS h
    FROM sizes),
plan AS (SELECT c.*, least(h, coalesce(b.n, 0)) AS given FROM crc c LEFT JOIN sizes b ON b.conv_id = c.base),
made AS (
    SELECT p.conv_id, t.pos, role, text FROM plan p JOIN t ON t.conv_id = p.base AND t.pos <= p.given
    UNION ALL SELECT p.conv_id, t.pos - h + given, role, text FROM plan p JOIN t USING (conv_id) WHERE t.pos > h),
paths AS (SELECT p.conv_id, coalesce(list({'r': role, 't': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns FROM plan p LEFT JOIN made m USING (conv_id) GROUP BY p.conv_id),
members AS (SELECT conv_id, turns, d AS depth, turns[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM paths)),
nodes AS (
    SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256
    FROM members GROUP BY depth, prefix),
tree AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (n_convs - 1) * coalesce(length(n.prefix[n.depth].t), 0) AS saved
    FROM nodes n LEFT JOIN (SELECT depth, prefix, conv_id FROM nodes) p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
kids AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n FROM tree WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT t.*, coalesce(k.n, 0) AS n_children FROM tree t LEFT JOIN kids k ON k.depth = t.depth AND k.conv_id = t.conv_id),
ups AS (SELECT *, unnest(range(0, depth + 1)) AS up FROM counted),
sums AS (SELECT up AS depth, prefix[1:up] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM ups GROUP BY ALL)
SELECT c.conv_id, c.depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM counted c JOIN sums s ON s.depth = c.depth AND s.prefix = c.prefix
""",
}
