"""Secret scan: fixed patterns, and assignments read from source and configuration syntax.

The assignment reader lexes ``name = "literal"``, ``"name": "literal"``, ``name: literal``
and ``<name>literal</name>`` into name-literal pairs, past type annotations and subscripts, in
comments too, and with the literal on the next line; it joins literals with ``+``, carries constants
along ``name = other_name``, and scores each literal by the sensitivity of the names that it
reaches and by how random it looks. Literals joined by ``+`` are scored as their whole, and each of
them is a span. Literals at or above the threshold are added as kind ``lexed``, unless a fixed
pattern covers them already.

Edge cases: null and empty texts have no spans; spans count code points, end exclusive; equal
spans of a kind are listed once; texts are scanned whole, in time that grows with their length
alone; repeated rows, and rows with a null or repeated ``doc_id``, are scanned each; an empty table
gives an empty one. :func:`secret_spans` reads no columns but ``doc_id`` and ``text``; :func:`redact`
hands all others on as they are, whatever their names, but for an integer column ``n_chars``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from codeatlas.llm.common import mapped, small_batches

#: The patterns of the base kinds and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 2.5

#: Parts of names that call for secrecy, with their weight. A mixed, random literal adds 1.0, so that
#: the least weight still reaches the threshold.
SENSITIVE = {
    "password": 3.0,
    "passwd": 3.0,
    "passphrase": 3.0,
    "pwd": 2.0,
    "secret": 3.0,
    "token": 2.5,
    "apikey": 3.0,
    "accesskey": 3.0,
    "privatekey": 3.0,
    "credential": 2.5,
    "credentials": 2.5,
    "auth": 1.5,
    "bearer": 2.0,
    "signature": 1.5,
    "salt": 1.5,
    "key": 1.5,
}
#: Values that stand for a secret but are none.
PLACEHOLDERS = re.compile(r"(?:x+|\*+|your[-_ ].*|change[-_ ]?me|example.*|none|null|true|false|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|process\.env.*|os\.environ.*)", re.IGNORECASE)

_QUOTES = "\"'`"
_STRINGS = {'"': r'''"(?:[^"\\\n]|\\.)*"''', "'": r"""'(?:[^'\\\n]|\\.)*'""", "`": r"`(?:[^`\\]|\\.)*`"}


@cache
def _token(quotes: str = _QUOTES) -> re.Pattern:
    """The next token, with strings in these ``quotes`` only."""
    strings = "|".join(_STRINGS[q] for q in quotes) or r"(?!)"
    return re.compile(
        rf"""(?P<comment>//|\#)
        |(?P<string>{strings})
        |(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
        |(?P<number>\d[\w.]*)
        |(?P<op>:=|=>|==|!=|<=|>=|[=:+])
        |(?P<line>\n)
        |(?P<other>\S)""",
        re.VERBOSE | re.ASCII,
    )


#: What a name may be the beginning of, if it is the scheme of a URL.
_SCHEME = re.compile(r"[A-Za-z\d+.-]*", re.ASCII)
#: A type between a colon and ``=``: a literal, a bracket or the line's end follows, or a blank stands before ``=``.
_TYPED = re.compile(r"(?:&[ \t]*)?(?:'static[ \t]+)?[A-Za-z_$](?:[\w$.\[\]<>?]++|[ \t]*+[|&,][ \t]*+)*+(?:[ \t]*+=(?=[ \t]*[\"'`(\\])|[ \t]++=(?![=>]))", re.ASCII)
#: Behind a string that is a name itself.
_KEY = re.compile(r"[ \t]*(?:\][ \t]*)?(?:=(?!=)|:)")
_BARE = re.compile(r"[^\s\"'`,;<>()\[\]{}]+")
_TAG = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\s]+)</\1>", re.ASCII)
_SIGN = re.compile(r"[=:<]")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns as (start, end, kind)."""
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def sensitivity(name: str) -> float:
    """Largest weight among a name's parts and neighbouring parts, camel and snake case alike."""
    parts = [p.lower() for p in _PART.findall(name)]
    joined = [*parts, *(a + b for a, b in zip(parts, parts[1:], strict=False))]
    return max((SENSITIVE.get(p, 0.0) for p in joined), default=0.0)


def randomness(value: str) -> float:
    """Bits for each character, from the value's own letter frequencies."""
    size = len(value)
    return -sum(n / size * math.log2(n / size) for n in Counter(value).values()) if size else 0.0


def score(weight: float, value: str) -> float:
    """How likely a literal is a secret, from the largest weight of its names and its own look."""
    if weight == 0 or len(value) < 6 or PLACEHOLDERS.fullmatch(value):
        return 0.0
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return weight + (0.5 if mixed else -1.0) + (0.5 if randomness(value) >= 3.0 else -0.5)


#: A literal: its value, and the places of its parts.
Literal = tuple[str, tuple[tuple[int, int], ...]]


def assignments(text: str) -> tuple[list[tuple[str, Literal]], list[tuple[str, str]]]:
    """(name, literal) of every assignment in the text, and (name, other name) of those that hand on a constant."""
    pairs: list[tuple[str, Literal]] = []
    aliases: list[tuple[str, str]] = []
    if "</" in text:
        pairs += [(m[1], (m[2], (m.span(2),))) for m in _TAG.finditer(text)]
    target, sign = "", ""
    for lo, hi in _lines(text):
        if not sign:
            target = ""
            if _SIGN.search(text, lo, hi) is None:
                continue
        # A sign at the end of the line before takes a literal only, as does a bracket.
        at, literal, held, quotes, plain = lo, bool(sign), "", _QUOTES, lo
        while (m := _token(quotes).search(text, at, hi)) is not None:
            kind, at = m.lastgroup, m.end()
            if kind == "other" and m[0] in quotes:
                # Nothing ends a string in these quotes behind here, so the line isn't searched for it again.
                quotes = quotes.replace(m[0], "")
            if kind == "comment":
                # What stands behind the mark is read too; a sign before it waits for the next line.
                if sign:
                    held, target, sign = held or target, "", ""
                continue
            if sign and m[0] in ("(", "\\"):
                literal = True
                continue
            if sign and literal and (kind != "string" or _KEY.match(text, at, hi)):
                target, sign = "", ""
            if sign:
                if sign == ":" and (typed := _TYPED.match(text, m.start(), hi)):
                    at, sign = typed.end(), "="
                    continue
                values, at, names = _value(text, m, hi, _token(quotes))
                pairs += [(target, value) for value in values]
                aliases += [(target, name) for name in names]
                target, sign = "", ""
            elif kind == "op" and m[0] in ("=", ":", ":=", "=>"):
                sign, literal = m[0] if target else "", False
            elif kind == "name":
                target = m[0]
                if m.start() >= plain:
                    plain = _SCHEME.match(text, m.start(), hi).end()
                    if text.startswith("://", plain, hi):
                        target, at = "", plain + 3
            elif kind == "string":
                target = m[0][1:-1]
            elif m[0] in ("[", "]") or (m[0] in ("?", "!") and text[at : at + 1] == ":"):
                continue
            elif kind != "number":
                target = ""
        if held and not sign:
            target, sign = held, "="
    return pairs, aliases


def reach(names: Iterable[str], aliases: list[tuple[str, str]]) -> dict[str, float]:
    """The largest sensitivity among the names that a constant of each name is handed on to.

    Weights go from a name to those that it takes its constants from, largest first, so that each
    name is visited once.
    """
    weights = {name: sensitivity(name) for name in {*names, *(x for pair in aliases for x in pair)}}
    sources: dict[str, list[str]] = {}
    for target, name in aliases:
        sources.setdefault(target, []).append(name)
    out: dict[str, float] = {}
    for start in sorted(weights, key=lambda x: -weights[x]):
        queue = [start]
        while queue:
            name = queue.pop()
            if name not in out:
                out[name] = weights[start]
                queue += sources.get(name, ())
    return out


def _lines(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield at, end
        at = end + 1


_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_DOTTED = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)+")


def _value(text: str, m: re.Match, hi: int, token: re.Pattern) -> tuple[list[Literal], int, list[str]]:
    """What stands right of a sign: literals with their places, where it ends, names used.

    Strings of a sum are one literal; a bare word is one by itself, and may be a name as well.
    """
    strings: list[tuple[str, tuple[int, int]]] = []
    values: list[Literal] = []
    names, at = [], m.end()
    while True:
        if m.lastgroup == "string":
            strings.append((m[0][1:-1], (m.start() + 1, m.end() - 1)))
            at = m.end()
        elif (bare := _BARE.match(text, m.start(), hi)) is not None:
            word = bare[0].rstrip(".!?")
            at = bare.end()
            if word.isidentifier() or _DOTTED.fullmatch(word):
                names.append(word)
            values.append((word, ((m.start(), m.start() + len(word)),)))
        else:
            break
        plus = _PLUS.match(text, at, hi)
        if plus is None or (following := token.match(text, plus.end(), hi)) is None:
            break
        m = following
    if strings:
        values.append(("".join(x for x, _ in strings), tuple(place for x, place in strings if x)))
    return values, at, names


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """Literals whose score, over all names they reach, is at or above the threshold."""
    if not _SIGN.search(text):
        return []
    pairs, aliases = assignments(text)
    weights = reach((name for name, _ in pairs), aliases)
    best: dict[Literal, float] = {}
    assigned, handed = {name for name, _ in pairs}, set(aliases)
    for name, literal in pairs:
        if literal[0] in assigned and (name, literal[0]) in handed:
            continue  # a name that the text itself assigns, not a bare literal
        best[literal] = max(best.get(literal, 0.0), weights[name])
    found = {place for (value, places), weight in best.items() if score(weight, value) >= threshold for place in places}
    return sorted((start, end, "lexed") for start, end in found)


def scan(text: str | None, threshold: float = THRESHOLD) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans in order of start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    starts, ends = [b[0] for b in base], list(accumulate((b[1] for b in base), max))
    # A span is covered if one of those that begin no later ends no sooner.
    covered = lambda s: (n := bisect_right(starts, s[0])) > 0 and ends[n - 1] >= s[1]
    added = [s for s in lexed_spans(text, threshold) if not covered(s)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redacted(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span replaced by a mark; overlapping spans become one."""
    _, spans = scan(text)
    if not spans:
        return text
    out, at, end = [], 0, 0
    for start, stop, _ in spans:
        if start >= end:
            out += [text[at:start], mark] if start > at or not out else [mark]
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]


FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_assign", T.LongType()),
        T.StructField("n_access", T.LongType()),
        T.StructField("n_hex", T.LongType()),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_lexed", T.LongType()),
    ]
)


def secret_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, digest and list of the spans of each row of ``docs`` (``doc_id``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                base, spans = scan(text, threshold)
                n = Counter(kind for _, _, kind in spans)
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                rows.append((doc, n["assign"], n["access"], n["hex"], digest, listed(spans), n["lexed"]))
            yield rows

    return mapped(docs.select("doc_id", "text"), run, FOUND)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked and an integer ``n_chars``, where there is one, brought up to date."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size = (batch.schema.get_field_index(c) for c in ("text", "n_chars"))
            before = batch.column(at).to_pylist()
            after = list(map(redacted, before))
            batch = batch.set_column(at, batch.schema.field(at), pa.array(after, batch.schema.field(at).type))
            if size >= 0 and pa.types.is_integer(batch.schema.field(size).type):
                sizes = [n if new is None or new == old else len(new) for n, old, new in zip(batch.column(size).to_pylist(), before, after, strict=True)]
                batch = batch.set_column(size, batch.schema.field(size), pa.array(sizes, batch.schema.field(size).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
