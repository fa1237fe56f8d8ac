"""Full-text analyzers: plain folding as column expressions, and stems of lists of tokens by an Arrow UDF."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.functions.porter import stem


def _folds() -> tuple[str, str]:
    """Lower-case Latin letters with a diacritic, and their base letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if letter == letter.lower() and len(parts) > 1 and unicodedata.combining(parts[1]) and parts[0].isascii():
            pairs.append((letter, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folds()
NOT_WORD = r"[^\p{L}\p{N}]+"


def folded(col: Column | str) -> Column:
    """Lower case without diacritics of Latin letters."""
    return F.translate(F.lower(col), ACCENTED, PLAIN)


def plain_tokens(col: Column | str) -> Column:
    """Tokens of the plain analyzer, in order."""
    return F.filter(F.split(folded(F.coalesce(col, F.lit(""))), NOT_WORD), lambda t: F.length(t) > 0)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stems_of(tokens: pa.Array) -> pa.Array:
    """Stems of lists of tokens; each word of a batch is stemmed once."""
    words = tokens.flatten().dictionary_encode()
    stems = pa.array([stem(word) for word in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0)).cast(pa.int32())
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stems)


def fold_value(text: str) -> str:
    return text.lower().translate(str.maketrans(ACCENTED, PLAIN))


def value_tokens(text: str, porter: bool) -> list[str]:
    """Tokens of a query string on the driver, by the same rules."""
    words, word = [], ""
    for c in [*fold_value(text), " "]:
        if unicodedata.category(c)[0] in "LN":
            word += c
        elif word:
            words.append(stem(word) if porter else word)
            word = ""
    return words
