"""Vectors: hashed bag-of-words embeddings and cosine similarity, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME, FNV_MASK = 2166136261, 16777619, 4294967295
LEAST_DIMENSIONS, MOST_DIMENSIONS = 8, 256
DIGITS = 8


def clamp_dimensions(dimensions: int) -> int:
    return max(LEAST_DIMENSIONS, min(dimensions, MOST_DIMENSIONS))


def word_tokens(col: Column | str) -> Column:
    return F.filter(F.split(F.lower(col), "[^a-z0-9_]+"), lambda t: F.length(t) > 0)


def fnv1a(token: Column) -> Column:
    """Hash of an ASCII token's characters, as a non-negative long."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(FNV_MASK).cast("long")))


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))


def normalized(vector: Column) -> Column:
    """Unit length, rounded to eight decimals; a zero vector stays."""
    norm = l2_norm(vector)
    return F.when(norm == 0, vector).otherwise(F.transform(vector, lambda x: F.round(x / norm, DIGITS)))


def hashed_embedding(text: Column | str, dimensions: int) -> Column:
    """Bag of words in hashed buckets, normalised.

    Each token adds one to its bucket; the number of dimensions is bounded, so the dense
    vector is too.
    """
    size = clamp_dimensions(dimensions)
    buckets = F.transform(word_tokens(text), lambda t: (fnv1a(t) % size).cast("int"))
    zeros = F.array_repeat(F.lit(0.0), size)
    counts = F.aggregate(buckets, zeros, lambda held, b: F.transform(held, lambda x, i: F.when(i == b, x + 1).otherwise(x)))
    return normalized(counts)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 for an empty or zero vector."""
    size = F.least(F.size(a), F.size(b))
    x, y = (F.slice(v, 1, F.greatest(size, F.lit(1))) for v in (a, b))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = l2_norm(F.transform(x, lambda v: v.cast("double"))) * l2_norm(F.transform(y, lambda v: v.cast("double")))
    return F.when((size <= 0) | (norms == 0), F.lit(0.0)).otherwise(dot / norms)
