"""Embedding providers by name."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.functions.vectors import clamp_dimensions, hashed_embedding


@dataclass(frozen=True)
class Provider:
    """A model and how it turns a text column into a vector column."""

    kind: str
    model: str
    dimensions: int
    embed: Callable[[Column], Column]

    def embed_value(self, spark: SparkSession, text: str) -> list[float]:
        return spark.range(1).select(self.embed(F.lit(text)).alias("v")).first()["v"]


def _mock(config: dict[str, Any]) -> Provider:
    size = clamp_dimensions(config["dimensions"])
    return Provider("mock", config["model"], size, lambda text: hashed_embedding(text, size))


#: Where a remote provider answers, and the variable that holds its key.
ENDPOINT, KEY_VARIABLE = "https://api.openai.com/v1/embeddings", "OPENAI_API_KEY"
#: Texts of one request, and seconds that it may take.
TEXTS, SECONDS = 64, 60


def _ask(endpoint: str, key: str, model: str, size: int, texts: list[str]) -> list[list[float]]:
    """Vectors of some texts, in their order; an empty one where the answer has none."""
    body = json.dumps({"input": texts, "model": model, "dimensions": size}).encode()
    request = urllib.request.Request(endpoint, body, {"content-type": "application/json", "authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=SECONDS) as reply:
        data = json.load(reply).get("data") or []
    # An answer says which text it belongs to; without that, answers come in the order of the texts.
    found = {x.get("index", n): x.get("embedding") or [] for n, x in enumerate(data)}
    return [found.get(n, []) for n in range(len(texts))]


def _remote(config: dict[str, Any]) -> Provider | None:
    """Vectors from a service over HTTP, a batch of texts to a request; none without a key.

    Workers read the key from their own environment (``spark.executorEnv`` on a cluster), so that it is
    no part of a plan.
    """
    size, model, endpoint, variable = config["dimensions"], config["model"], ENDPOINT, KEY_VARIABLE
    if not os.environ.get(variable, "").strip():
        return None

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(texts: pd.Series) -> pd.Series:
        key, asked = os.environ.get(variable, "").strip(), texts.fillna("").tolist()
        return pd.Series([x for at in range(0, len(asked), TEXTS) for x in _ask(endpoint, key, model, size, asked[at : at + TEXTS])], dtype=object)

    return Provider("openai", model, size, lambda text: embed(text))


#: Providers may be added: a name and a function from the embeddings section to a provider or None.
REGISTRY: dict[str, Callable[[dict[str, Any]], Provider | None]] = {"mock": _mock, "openai": _remote}


def resolve_provider(config: dict[str, Any]) -> Provider | None:
    """The configured provider; none when embeddings are off or the name is unknown."""
    section = config["embeddings"]
    return REGISTRY[section["provider"]](section) if section["enabled"] and section["provider"] in REGISTRY else None
