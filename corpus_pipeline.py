"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept: toxic documents go, exact copies go, one document
of each near-duplicate group stays, secrets are masked, and the rest is packed. Every stage's
result is written to the shared folder and read again, so a lost executor costs a stage at most.

Edge cases, by stage. ``toxicity``: null and empty texts score as texts without features and stay
unless all do; repeated rows are judged alike; without labels of both kinds the share of label 1
decides. ``exact_dedup``: null counts as empty, and one of all empty texts stays; ties go to the
smaller ``doc_id``, then to the place. ``near_dedup``: rows without words, or with a null ``doc_id``,
stay; rows that share a ``doc_id`` that stays all stay. ``secrets``: no row goes; null stays null;
``n_chars`` follows where it is an integer. ``packing``: a null or empty text is its end id alone.
Very long texts are read whole throughout, empty tables give empty results, and extra columns, whatever
their names, come through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeatlas.llm import exact_dedup, near_dedup, packing, secrets, toxicity
from codeatlas.llm.common import read_table, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # The classifier learns from the labelled documents of the whole table.
    model = toxicity.learn(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_best(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_first(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express the classifier, the tokens or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
