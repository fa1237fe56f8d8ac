"""Repeated lines or paragraphs, and passages inside them, by hashing.

Units are lines (or paragraphs). A unit is normalised (letters lower-cased, runs of white space
as one blank, outer punctuation dropped) and hashed to a 128-bit cryptographic digest, which stands
for its text; digests are grouped over all documents. The earliest occurrence, by ``doc_id`` and then
offset, stays, and every later one is removed, however short it is.

Copied passages often begin or end inside a line, which whole lines miss. So the sentences of
a line are hashed as well, and sentences that occurred earlier are removed where at least
``passage_words`` words of them follow each other; a line that is removed as a whole counts as
such evidence for the sentences beside it.

Edge cases: null, empty and blank texts have no units; rows with a null ``doc_id`` come last;
rows that share a ``doc_id``, copies of a row too, are told apart by a row number; offsets count
code points of the original text; texts are read whole; an empty table gives an empty one; columns
other than ``doc_id`` and ``text`` are not read by :func:`repeated_passages`, and handed on as they
are by :func:`without_repeats`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import drop_path, fresh, mapped, release, stored

#: Words of neighbouring repeated sentences that make a passage inside lines which aren't repeated as a whole.
PASSAGE_WORDS = 25
_SENTENCE = re.compile(r"[^\n]*?(?:[.!?](?=\s)|(?=\n)|\Z)")
_EDGE = " \t\r\f\v.,;:!?\"'()[]{}*#$%&"

UNITS = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("unit", T.IntegerType()),
        T.StructField("parts", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("words", T.IntegerType()),
        T.StructField("digest", T.BinaryType()),
    ]
)


def units(text: str | None, by: str = "line", lo: int = 0, hi: int | None = None) -> list[tuple[int, int, str]]:
    """(start, end, normalised) of each unit (paragraph, line or sentence) that has a word."""
    found = []
    text = text or ""
    at, size = lo, len(text) if hi is None else hi
    while at < size:
        if by == "sentence":
            end = _SENTENCE.match(text, at, size).end()
        else:
            end = text.find("\n\n" if by == "paragraph" else "\n", at, size)
            end = size if end < 0 else end
        start = at
        while start < end and text[start].isspace():
            start += 1
        normal = " ".join(text[start:end].lower().split()).strip(_EDGE)
        if normal:
            found.append((start, end, normal))
        at = max(end, at + 1)
    return found


def nested(text: str | None, by: str = "line") -> Iterator[tuple[int, int, int, int, str]]:
    """(number of its first sentence, how many it has, start, end, normalised) of each unit, then its sentences, with 0 parts.

    A unit of one sentence comes once and stands for both.
    """
    number = 0
    for start, end, normal in units(text, by):
        inner = units(text, "sentence", start, end)
        yield number, len(inner), start, end, normal
        if len(inner) > 1:
            yield from ((number + k, 0, *x) for k, x in enumerate(inner))
        number += len(inner)


def hashed_units(docs: DataFrame, by: str = "line") -> DataFrame:
    """A row for each unit and sentence of each document, with its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        digest = hashlib.blake2b
        for batch in batches:
            rows = []
            for row, doc, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                rows += [(row, doc, n, parts, start, end, normal.count(" ") + 1, digest(normal.encode(), digest_size=16).digest()) for n, parts, start, end, normal in nested(text, by)]
                if len(rows) > 20_000:
                    yield rows
                    rows = []
            yield rows

    return mapped(docs.select("row", "doc_id", "text"), run, UNITS)


def _in_runs(by: str) -> Column:
    """Number of the run of neighbouring sentences that a row of column ``unit`` lies in."""
    return F.col("unit") - F.row_number().over(Window.partitionBy(by).orderBy("unit"))


def repeated_passages(docs: DataFrame, by: str = "line", passage_words: int = PASSAGE_WORDS, row: str | None = None) -> DataFrame:
    """Passages to remove: ``row, doc_id, start, end, n_words, n_units, copies, keep_doc_id, keep_start, whole_lines``.

    One row for each run of neighbouring sentences that go; ``whole_lines`` says that all of
    them lie in repeated lines (or paragraphs). ``copies`` is the largest number of occurrences of one
    of its sentences, and ``keep_doc_id, keep_start`` name the earliest occurrence of its first.
    ``row`` names a column that tells the rows of ``docs`` apart, if there is one.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", (F.monotonically_increasing_id() if row is None else F.col(row)).alias("row"))
    held, path = stored(hashed_units(docs, by), "units")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "start")
    groups, _ = stored(held.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1"), "repeats")
    release(spark)
    later, _ = stored(
        held.join(groups, "digest")
        .where((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
        .select("row", "doc_id", "unit", "parts", "start", "end", "words", "copies", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start")),
        "later",
    )
    drop_path(spark, path)
    release(spark)
    # The sentences of a repeated line occurred earlier too; they follow its own row.
    reached = F.max(F.when(F.col("parts") > 0, F.col("unit") + F.col("parts"))).over(Window.partitionBy("row").orderBy("unit", F.col("parts").desc()).rowsBetween(Window.unboundedPreceding, 0))
    sentences = later.withColumn("whole", F.coalesce(reached > F.col("unit"), F.lit(False))).where("parts <= 1")
    near = sentences.withColumn("run", _in_runs("row"))
    near = near.withColumn("together", F.sum("words").over(Window.partitionBy("row", "run")))
    runs = near.where(F.col("whole") | (F.col("together") >= passage_words)).withColumn("run", _in_runs("row"))
    return (
        runs.groupBy("row", "run")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sum("words").alias("n_words"),
            F.count("*").alias("n_units"),
            F.max("copies").alias("copies"),
            F.min(F.struct("start", "keep_doc_id", "keep_start")).alias("kept"),
            F.every("whole").alias("whole_lines"),
        )
        .select("row", "doc_id", "start", "end", "n_words", "n_units", "copies", F.col("kept.keep_doc_id").alias("keep_doc_id"), F.col("kept.keep_start").alias("keep_start"), "whole_lines")
    )


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the given spans (ascending, apart from each other)."""
    if text is None:
        return None
    out, at = [], 0
    for start, end in sorted(spans):
        out.append(text[at:start])
        at = end
    return "".join(out) + text[at:]


def without_repeats(docs: DataFrame, by: str = "line", passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; a last column lists their original offsets.

    That column is called ``removed``, with underscores behind it if ``docs`` has such a column.
    """
    row, removed, shorter = fresh("row", docs), fresh("removed", docs), fresh("shorter", docs)
    numbers, _ = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    passages = repeated_passages(numbers, by, passage_words, row)
    spans = passages.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(removed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts, gone = batch["text"].to_pylist(), batch[removed].to_pylist()
            yield {row: batch[row], removed: batch[removed], shorter: [cut(t, [(s["start"], s["end"]) for s in g or ()]) for t, g in zip(texts, gone, strict=True)]}

    # Only rows that lose something pass through Python.
    touched = numbers.select(row, "text").join(spans, row)
    schema = T.StructType([T.StructField(row, T.LongType()), T.StructField(removed, touched.schema[removed].dataType), T.StructField(shorter, T.StringType())])
    done = mapped(touched, run, schema)
    joined = numbers.join(done, row, "left")
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.col(shorter))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns], removed)
