"""Text functions of the engine: query tokens, expansion, LIKE patterns, names and versions.

Functions on plain values prepare a query on the driver; functions on columns do the same for
whole tables of queries.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words that stand for each other in natural-language queries.
SYNONYMS = {
    "handler": ["handle", "processor", "consumer"],
    "message": ["messages", "payload", "event"],
    "webhook": ["hook", "endpoint", "controller"],
    "status": ["state", "health"],
    "config": ["configuration", "settings"],
    "auth": ["authentication", "token"],
}

LEAST_TOKEN = 2
SIGNATURE_CHARS = 256


def by_locale(col: str) -> list[Column]:
    """Order of a text as readers sort it: letters before case and accents; equal ones by their code points."""
    return [F.collate(F.col(col), "UNICODE"), F.col(col)]


def ascii_lower(col: Column | str) -> Column:
    """Lower-case A-Z alone; other letters keep their case in stored values."""
    return F.translate(col, UPPER, LOWER)


# -- query tokens -------------------------------------------------------------


def query_tokens(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores of at least two characters."""
    return [t for t in re.split(r"[^a-z0-9_]+", text.lower()) if len(t) >= LEAST_TOKEN]


def query_tokens_column(col: Column | str, least: int = LEAST_TOKEN) -> Column:
    return F.filter(F.split(F.lower(col), "[^a-z0-9_]+"), lambda t: F.length(t) >= least)


def singular(token: str) -> str:
    return token[:-1] if token.endswith("s") and len(token) > 3 else token


def singular_column(token: Column) -> Column:
    return F.when(token.endswith("s") & (F.length(token) > 3), token.substr(F.lit(1), F.length(token) - 1)).otherwise(token)


def expanded_tokens(tokens: list[str]) -> list[str]:
    """Tokens, their singulars and their synonyms, each once, in order of first mention."""
    found: dict[str, None] = {}
    for token in tokens:
        for term in (token, singular(token), *SYNONYMS.get(token, ())):
            if len(term) >= LEAST_TOKEN:
                found.setdefault(term)
    return list(found)


def expanded_tokens_column(tokens: Column) -> Column:
    table = F.create_map(*[x for word, others in SYNONYMS.items() for x in (F.lit(word), F.array(*map(F.lit, others)))])
    none = F.array().cast("array<string>")
    terms = F.transform(tokens, lambda t: F.concat(F.array(t, singular_column(t)), F.coalesce(F.try_element_at(table, t), none)))
    return F.filter(F.array_distinct(F.flatten(terms)), lambda t: F.length(t) >= LEAST_TOKEN)


# -- full-text query plans ----------------------------------------------------


@dataclass(frozen=True)
class TextPlan:
    """A full-text query: prefix terms joined by ``and`` or ``or``, or one exact phrase."""

    terms: tuple[str, ...]
    mode: str  # and, or, phrase


def strict_plan(query: str) -> TextPlan:
    """All tokens as prefixes; without a token the raw query as a phrase."""
    tokens = query_tokens(query)
    return TextPlan(tuple(tokens), "and") if tokens else TextPlan((query,), "phrase")


def loose_plan(tokens: list[str], expanded: list[str]) -> TextPlan | None:
    """Any of the tokens and expanded terms as prefixes."""
    terms = [t.replace('"', "").replace("*", "") for t in dict.fromkeys([*tokens, *expanded])]
    terms = [t for t in terms if len(t) >= LEAST_TOKEN]
    return TextPlan(tuple(terms), "or") if terms else None


def text_plans(query: str) -> list[TextPlan]:
    """The strict plan, then the loose one unless it says the same."""
    tokens = query_tokens(query)
    plans = [strict_plan(query), loose_plan(tokens, expanded_tokens(tokens))]
    if plans[1] is None or (len(plans[1].terms) == 1 and plans[1].terms == plans[0].terms):
        return plans[:1]
    return plans  # type: ignore[return-value]


# -- LIKE ---------------------------------------------------------------------


def like_pattern(term: str) -> str:
    """``%term%`` with live wildcards; only backslashes are escaped, as Spark would read them."""
    return "%" + term.replace("\\", "\\\\") + "%"


def contains_like(col: Column, term: str) -> Column:
    """LIKE of a pattern made from a raw term; a plain search where it holds no wildcard."""
    return col.like(like_pattern(term)) if "%" in term or "_" in term else col.contains(term)


def any_like(col: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | contains_like(col, term)
    return found


# -- names, languages, versions -----------------------------------------------


def language_of(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.when(path.rlike(r"\.tsx?$"), "typescript").otherwise("javascript")


def is_source(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(r"\.(ts|tsx|js|jsx)$")


def signature_of(kind: Column, content: Column, name: Column) -> Column:
    """The beginning of a function's text, else the name."""
    return F.when(kind == "function", F.substring(content, 1, SIGNATURE_CHARS)).otherwise(name)


def version_parts(col: Column | str) -> Column:
    """Numbers of a version: what precedes the first digit is dropped, a part without a number is 0."""
    parts = F.split(F.regexp_replace(F.trim(col), "^[^0-9]*", ""), r"\.")
    return F.transform(parts, lambda x: F.coalesce(F.regexp_extract(x, r"^\s*([+-]?\d+)", 1).try_cast("long"), F.lit(0).cast("long")))


def compare_versions(left: Column | str, right: Column | str) -> Column:
    """1, 0 or -1 as the left version is newer, equal or older; missing parts count as 0."""
    a, b = version_parts(left), version_parts(right)
    size = F.greatest(F.size(a), F.size(b))
    a, b = (F.concat(x, F.array_repeat(F.lit(0).cast("long"), size - F.size(x))) for x in (a, b))
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)


def nearest_rank(column: str, percent: float) -> Column:
    """Percentile by nearest rank: the smallest value with at least ``percent`` of all at or below it."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{column}`)")
