"""Toxicity by a linear classifier with a counterfactual penalty.

Features are the distinct words of a text and the beginnings of its words. Training adds, for
every labelled text that names a group of people, the same text with the group swapped for
another one and with a word that names none, and penalises the squared changes of its score. A
mention alone then can't carry the score, which keeps neutral texts about a group from being
flagged.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled rows (those with the
smallest hash of their id) and at most ``MOST_FEATURES`` features of each (those with the smallest
hash), which bounds what the driver gathers to some hundred MB whatever the texts. Every row of
the table is scored on its whole text, and ``doc_id`` has no part in a score or weight beyond
the choice of the sample.

Edge cases: null and empty texts get the score of a text without features; labels that are
null or name no document are not used; of several labels of a document the largest counts;
labelled rows that share a ``doc_id`` are learned from each; without a label of each kind all
scores are the share of label 1; repeated rows and rows with a null ``doc_id`` are scored each,
the latter not held out; equal texts get equal scores; an empty table gives an empty one; columns
other than ``doc_id`` and ``text`` are not read when scoring, and :func:`keep_below` hands all
columns on as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import mapped, small_batches

#: Most labelled rows that the classifier is fitted on.
SAMPLE = 12_000
#: Most features of a text that the classifier is fitted on; some 1,000 different words have as many.
MOST_FEATURES = 4096
FEATURES = 12_000
LEAST_DOCS = 3
THRESHOLD = 0.3
PENALTY = 6.0
#: Weight of a toxic text in the loss; one in ten is toxic, and missing one is worse.
TOXIC_WEIGHT = 3.0
RIDGE = 1e-4
BEGINNINGS = (4, 5, 6)
CACHED_WORDS = 150_000

#: Terms that name groups of people, by kind; a term is swapped within its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("african", "american", "european", "chinese", "indian", "mexican", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"),
    ("femmes", "hommes"),
    ("mujeres", "hombres"),
)
NEUTRAL = "people"
_SWAP = {term: [x for x in kind if x != term] for kind in IDENTITIES for term in kind}
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def swapped(words: set[str], seed: int) -> set[str]:
    """The same words with each identity term replaced by another of its kind."""
    out = set()
    for word in words:
        others = _SWAP.get(word)
        out.add(others[(seed + len(word)) % len(others)] if others else word)
    return out


def neutral(words: set[str]) -> set[str]:
    """The same words with one word that names no group in place of all identity terms."""
    return {word for word in words if word not in _SWAP} | {NEUTRAL}


def feature_hashes(words: set[str]) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the features of a set of words."""
    found = {xxhash.xxh32_intdigest(f) for w in words for f in features_of(w)}
    return np.sort(np.fromiter(found, dtype=np.uint32, count=len(found)))


class Classifier:
    """Weights by feature hash."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float):
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self.index = {int(h): i for i, h in enumerate(hashes)}
        self.known: dict[str, tuple[int, ...]] = {}

    def places(self, word: str) -> tuple[int, ...]:
        held = self.known.get(word)
        if held is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            index = self.index
            found = (index.get(xxhash.xxh32_intdigest(f)) for f in features_of(word))
            held = self.known[word] = tuple(i for i in found if i is not None)
        return held

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        for word in words_of(text):
            found.update(self.places(word))
        total = self.bias + float(self.weights[sorted(found)].sum()) if found else self.bias
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def _rows(held: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and places in ``chosen`` of the features of several texts."""
    rows, places = [], []
    for n, features in enumerate(held):
        at = np.searchsorted(chosen, features)
        at = at[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == features)]
        rows.append(np.full(len(at), n, dtype=np.int64))
        places.append(at.astype(np.int64))
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *places])


def _counts(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each feature and in how many texts it occurs; texts are joined a block at a time."""
    hashes, counts = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    for at in range(0, len(held), 1000):
        new, n = np.unique(np.concatenate(held[at : at + 1000]), return_counts=True)
        every, back = np.unique(np.concatenate([hashes, new]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, n]), len(every)).astype(np.int64)
        hashes = every
    return hashes, counts


def choose(held: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """The features whose shares in the two classes lie furthest apart, in standard errors."""
    hashes, total = _counts(held)
    toxic_hashes, toxic = _counts([x for x, label in zip(held, y, strict=True) if label])
    a = np.zeros(len(hashes))
    a[np.searchsorted(hashes, toxic_hashes)] = toxic
    n1, n0 = y.sum() + 1, len(y) - y.sum() + 1
    share = np.minimum((total + 1) / (n0 + n1), 0.999)
    apart = np.abs(a / n1 - (total - a) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    often = np.flatnonzero(total >= LEAST_DOCS)
    best = often[np.lexsort((hashes[often], -apart[often]))[:FEATURES]]
    terms = [xxhash.xxh32_intdigest(t) for t in _SWAP]
    return np.unique(np.concatenate([hashes[best], np.array(terms, dtype=np.uint32)]))


def fit(held: list[np.ndarray], labels: list[int], pairs: list[tuple[np.ndarray, np.ndarray]], penalty: float = PENALTY, rounds: int = 300) -> Classifier:
    """Logistic regression with ridge and counterfactual penalties, by Adam on all rows.

    ``held``: features of each labelled text; ``pairs``: features of the texts that name a
    group, as they are and with the group swapped or left unnamed.
    """
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Classifier(np.empty(0, dtype=np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    chosen = choose(held, y)
    rows, places = _rows(held, chosen)
    rows_a, places_a = _rows([a for a, _ in pairs], chosen)
    rows_b, places_b = _rows([b for _, b in pairs], chosen)
    w, bias = np.zeros(len(chosen)), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    mean, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(rows, w[places], len(y))
        error = (1 / (1 + np.exp(-z)) - y) * np.where(y > 0, TOXIC_WEIGHT, 1.0)
        grad = np.bincount(places, error[rows], len(w)) / len(y) + RIDGE * w
        if pairs:
            change = np.bincount(rows_a, w[places_a], len(pairs)) - np.bincount(rows_b, w[places_b], len(pairs))
            grad += penalty * 2 * (np.bincount(places_a, change[rows_a], len(w)) - np.bincount(places_b, change[rows_b], len(w))) / len(pairs)
        both = np.append(grad, error.mean())
        mean = 0.9 * mean + 0.1 * both
        square = 0.99 * square + 0.01 * both * both
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return Classifier(chosen, w, bias)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


LEARNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("toxic", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("own", "other", "none")]])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fit on at most ``sample`` rows: one of each labelled document that is not held out.

    Of rows that share a ``doc_id`` that with the least hash of its text is taken, before any row leaves
    its task for the driver, so neither repeated ids nor repeated rows add to what is gathered.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for doc, label, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                words = words_of(text)
                forms = [words]
                if any(w in _SWAP for w in words):
                    forms += [swapped(words, xxhash.xxh32_intdigest((text or "").encode())), neutral(words)]
                mark = xxhash.xxh3_64_intdigest((text or "").encode()) >> 1
                rows.append((doc, mark, int(label > 0), *[feature_hashes(x)[:MOST_FEATURES].tobytes() for x in forms], *[None] * (3 - len(forms))))
            yield rows

    chosen_rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    # At most ``sample`` rows of at most three times ``MOST_FEATURES`` hashes; not texts.
    forms = ("own", "other", "none")
    row = F.struct("mark", "toxic", *[F.coalesce(c, F.lit(b"")).alias(c) for c in forms])
    firsts = mapped(chosen_rows, run, LEARNED).groupBy("doc_id").agg(F.min(row).alias("row"))
    held = sorted(tuple(r) for r in firsts.select("row.toxic", *[f"row.{c}" for c in forms]).collect())
    array = lambda x: np.frombuffer(x, dtype=np.uint32)
    pairs = [(array(r[1]), array(x)) for r in held for x in r[2:] if x]
    return fit([array(r[1]) for r in held], [r[0] for r in held], pairs)


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


def scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """``doc_id, score`` of each row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.hashes, model.weights, model.bias))  # at most FEATURES entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own = Classifier(*sent.value)
        for batch in batches:
            yield {"doc_id": batch["doc_id"], "score": [own.score(x) for x in batch["text"].to_pylist()]}

    return mapped(docs.select("doc_id", "text"), run, SCORED)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row of ``docs``."""
    scored = scores(docs, learn(docs, labels, sample))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_below(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with its columns."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model.hashes, model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(*sent.value)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([own.score(x) < THRESHOLD for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
