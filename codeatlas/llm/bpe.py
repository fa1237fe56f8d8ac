"""Byte-pair encoding by backtracking, and decoding by an offset table.

Encoding walks a word with the longest vocabulary entry that starts at each position
(an Aho-Corasick automaton finds all of them in one pass) and takes an entry only if it may
follow the one before it. Whether two entries may stand side by side is looked up in a
pair-compatibility table: they may if merging their joined text gives exactly these two
entries. Where no entry fits, the last one is taken back and a shorter one is tried; a
position that failed is never tried again, so the work stays linear in the word's length and
the result equals applying the merges in order.

Texts are encoded a batch at a time. What stands between white space is looked up as a whole.
The new words of a batch are matched in one pass of the automaton over their joined text, and
then all of them take their steps forward and back together, in arrays.

Edge cases: null and empty texts give no ids, as does white space alone; special tokens are
recognised inside texts as the library does; lone surrogates cannot occur in Spark strings;
repeated rows and rows with a null or repeated ``doc_id`` are encoded each; an empty table
gives an empty one; a text's length is bounded by memory alone, as its ids are held at once;
columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import gc
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import mapped

#: Stands for the end-of-word suffix inside automaton keys; not in the byte alphabet.
END = "\x00"
#: Pieces between white space, and as many words, kept with their ids. When that many are new, they
#: become the old generation and the old one goes, so that frequent ones stay and memory is bounded.
CACHED = 200_000
LONGEST_CACHED = 64
#: Characters of new words that are matched in one pass.
PASS_CHARS = 1 << 19
#: Fewer words than this don't go on together.
LEAST_TOGETHER = 16
#: Pieces whose ids are gathered at once.
GATHERED = 1 << 17
#: Bytes of text that are encoded together.
GATHERED_BYTES = 4 << 20
#: Rows that are decoded and handed on together.
DECODED_ROWS = 256
#: Places of the pair table that the words going on together read; a power of two.
PAIR_PLACES = 1 << 20

#: Texts of these characters alone are in normal form C, and for them the standard
#: library's word classes and lower-casing agree with the tokenizer's.
_UNUSUAL = re.compile("[^\x00-\x1b\x20-\x7e\xa1\xa4-\xa9\xab-\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ňŊ-ž]")
_WORD = re.compile(r"[a-z]+(?![^\W\d_])|'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def byte_alphabet() -> list[str]:
    """The printable character of each byte value in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others follow from U+0100 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class PairTable:
    """Which two entries may be neighbours; answers are kept in a bounded table."""

    LIMIT = 1_000_000

    def __init__(self, rank: dict[int, int], parts: dict[int, tuple[int, int]], joined: dict[tuple[int, int], int]):
        self.rank, self.parts, self.joined = rank, parts, joined
        self.known: dict[tuple[int, int], bool] = {}
        # One answer for each place; another pair that falls there takes it over.
        self.pair_at = np.full(PAIR_PLACES, -1, dtype=np.int64)
        self.answer_at = np.zeros(PAIR_PLACES, dtype=bool)

    def fit_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """:meth:`fits` for arrays of entries."""
        pair = left << 32 | right
        place = (left * 0x9E3779B1 + right * 0x85EBCA77 >> 7) & (PAIR_PLACES - 1)
        new = np.flatnonzero(self.pair_at[place] != pair)
        answers = self.answer_at[place]
        if len(new):
            distinct, back = np.unique(pair[new], return_inverse=True)
            found = np.array([self.fits(x >> 32, x & 0xFFFFFFFF) for x in distinct.tolist()], dtype=bool)
            answers[new] = found[back]
            self.pair_at[place[new]] = pair[new]
            self.answer_at[place[new]] = answers[new]  # the last of equal places wins in both
        return answers

    def fits(self, left: int, right: int) -> bool:
        pair = (left, right)
        answer = self.known.get(pair)
        if answer is None:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            answer = self.known[pair] = self._decide(left, right)
        return answer

    def _decide(self, left: int, right: int) -> bool:
        """Undo the latest merge on either side of the border, again and again.

        A merge across the border that comes before the one undone last would have
        happened first, so the pair can't stand.
        """
        rank, parts, joined = self.rank, self.parts, self.joined
        limit = len(joined) + 1  # merges of this rank or later came too late; ties go to the left
        while True:
            across = joined.get((left, right))
            if across is not None and rank[across] < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b or (a == b and left == right):
                # The left entry was merged last. At equal rank the left one is merged first.
                if a == b:
                    limit, right = b + 1, parts[right][0]
                    continue
                limit, left = a, parts[left][1]
            else:
                limit, right = b + 1, parts[right][0]


class BacktrackingBPE:
    """Encoder and decoder for a vocabulary file with merges, word ends and byte alphabet."""

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        inner = lambda token: token[: -len(suffix)] + END if suffix and token.endswith(suffix) else token
        self.vocab = {inner(token): i for token, i in vocab.items()}
        rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        joined: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            joined[left, right] = whole
            rank.setdefault(whole, n)
            parts.setdefault(whole, (left, right))
        self.pairs = PairTable(rank, parts, joined)
        atoms = {t for t in self.vocab if len(t.rstrip(END)) == 1}
        self.finder = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        for token, i in self.vocab.items():
            if token in atoms or i in parts:
                self.length[i] = len(token)
                if token not in atoms:
                    self.finder.add_word(token, i)
        self.finder.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.library = Tokenizer.from_file(path)
        content = vocab | self.special
        size = max(content.values()) + 1
        texts = [b""] * size
        for token, i in content.items():
            texts[i] = token.encode() + b" "
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        self.sizes = np.zeros(size, dtype=np.int64)
        self.sizes[list(self.length)] = list(self.length.values())
        # Bytes read as Latin-1, as characters of the byte alphabet; a line feed ends a word.
        letters = byte_alphabet()
        self.letters = dict(enumerate(letters)) | {10: END}
        # Entries of one byte, inside a word and at its end; the automaton has the longer ones.
        self.atom = {x: (self.vocab.get(x), self.vocab.get(x + END)) for x in letters}
        self.atoms = np.array([[-1 if i is None else i for i in self.atom[x]] for x in letters], dtype=np.int64)
        self.pieces, self.words = _Kept(cached), _Kept(cached)

    # -- encoding ---------------------------------------------------------

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word, given in the byte alphabet."""
        key = word + END
        size = len(key)
        known, fits = self.pairs.known, self.pairs.fits
        # All entries by where they start; the matches come by their end, so short ones first.
        starts: list[list[tuple[int, int]]] = [[] for _ in key]
        for n, letter in enumerate(word):
            at_end = n == size - 2
            atom = self.atom[letter][at_end]
            if atom is not None:
                starts[n].append((1 + at_end, atom))
        for end, token in self.finder.iter(key):
            length = self.length[token]
            starts[end + 1 - length].append((length, token))
        dead = bytearray(size + 1)
        path: list[tuple[int, int, int]] = []  # (position, which of its entries, its id)
        at, left, last = 0, len(starts[0]), -1
        while at < size:
            choices = starts[at]
            while left:
                left -= 1
                length, token = choices[left]
                if not dead[at + length]:
                    if last < 0:
                        break
                    fit = known.get((last, token))
                    if fits(last, token) if fit is None else fit:
                        break
            else:
                if not path:
                    raise ValueError(f"no encoding of {word!r}")
                dead[at] = 1
                at, left, _ = path.pop()
                last = path[-1][2] if path else -1
                continue
            path.append((at, left, token))
            last = token
            at += length
            left = len(starts[at]) if at < size else 0
        return [token for _, _, token in path]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        out = [b""] * len(texts)
        plain = []
        for n, text in enumerate(texts):
            if text:
                if _UNUSUAL.search(text) or any(mark in text for mark in self.special):
                    out[n] = self._with_marks(text)
                else:
                    plain.append(n)
        for n, ids in zip(plain, self._plain([texts[n].lower() for n in plain]), strict=True):
            out[n] = ids
        self.pieces.settle()
        self.words.settle()
        return out

    def _with_marks(self, text: str) -> bytes:
        """Ids of a text with special tokens or characters that need the library's normalising."""
        out = []
        for part in self.splitter.split(text) if self.splitter else [text]:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif _UNUSUAL.search(part):
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [little_endian(self.word_ids(w)) for w, _ in words]
            elif part:
                out += self._plain([part.lower()])
        return b"".join(out)

    def _plain(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of lower-case texts that need no normalising: each distinct piece is looked up once."""
        split = pc.ascii_split_whitespace(pa.array(texts, pa.string()))  # no word reaches across white space
        coded = split.flatten().dictionary_encode()
        distinct, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        self._learn(distinct)
        known = self.pieces.now
        ids = [known[x] for x in distinct]
        blob = np.frombuffer(b"".join(ids), dtype="<u4")
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        borders = split.offsets.to_numpy()
        for lo, hi in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            parts = []
            for k in range(lo, hi, GATHERED):
                some = at[k : min(k + GATHERED, hi)]
                size = sizes[some]
                ends = np.cumsum(size)
                parts.append(blob[np.repeat(starts[some] - (ends - size), size) + np.arange(ends[-1])].tobytes())
            yield parts[0] if len(parts) == 1 else b"".join(parts)

    def _learn(self, wanted: list[str]) -> None:
        """Have the ids of all wanted pieces, which are distinct."""
        pieces = self.pieces.missing(wanted)
        split = list(map(_WORD.findall, pieces))
        words: set[str] = set()
        for found in split:
            words.update(found)
        chosen: list[str] = []
        size = 0
        for word in self.words.missing(words):
            chosen.append(word)
            size += len(word) + 1
            if size >= PASS_CHARS:
                self.words.now.update(zip(chosen, self.together(chosen), strict=True))
                chosen, size = [], 0
        if chosen:
            self.words.now.update(zip(chosen, self.together(chosen), strict=True))
        ids, known = self.words.now, self.pieces.now
        for piece, found in zip(pieces, split, strict=True):
            known[piece] = ids[found[0]] if len(found) == 1 else b"".join([ids[x] for x in found])

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, by the steps of :meth:`word_ids` for all of them at once.

        Arrays by word hold its position, the entries left there, its last entry and where that
        begins; arrays by position hold the entry chosen there, those left, and the position before.
        """
        joined = ("\n".join(words) + "\n").encode()
        raw = np.frombuffer(joined, dtype=np.uint8)
        text = joined.decode("latin-1").translate(self.letters)  # one character for each byte
        stops = np.flatnonzero(raw == 10)
        firsts = np.concatenate([[0], stops[:-1] + 1])
        found = np.fromiter(chain.from_iterable(self.finder.iter(text)), dtype=np.int64).reshape(-1, 2)
        at_end = np.zeros(len(raw), dtype=np.int64)
        at_end[stops - 1] = 1
        single = self.atoms[raw, at_end]
        places = np.flatnonzero((raw != 10) & (single >= 0))
        entry = np.concatenate([single[places], found[:, 1]])
        begins = np.concatenate([places, found[:, 0] + 1 - self.sizes[found[:, 1]]])
        order = np.argsort(begins, kind="stable")  # short ones first, as matches come by their end
        entry = entry[order]
        size = self.sizes[entry]
        high = np.cumsum(np.bincount(begins, minlength=len(text) + 1))
        low = np.concatenate([[0], high[:-1]])
        taken, chosen, before = (np.full(len(text) + 1, -1, dtype=np.int64) for _ in range(3))
        dead, on_path = np.zeros(len(text) + 1, dtype=bool), np.zeros(len(text) + 1, dtype=bool)
        at, last, last_at = firsts.copy(), np.full(len(words), -1), np.full(len(words), -1)
        left = high[at]
        going = np.arange(len(words))
        while len(going) >= LEAST_TOGETHER:
            more = left[going] > low[at[going]]
            tried = going[more]
            place = left[tried] - 1
            left[tried] = place
            new = entry[place]
            to = at[tried] + size[place]
            ok = ~dead[to]
            asked = np.flatnonzero(ok & (last[tried] >= 0))
            ok[asked] = self.pairs.fit_all(last[tried[asked]], new[asked])
            forth, place, new = tried[ok], place[ok], new[ok]
            here = at[forth]
            taken[here], chosen[here], before[here], on_path[here] = place, new, last_at[forth], True
            at[forth], last[forth], last_at[forth] = to[ok], new, here
            left[forth] = high[to[ok]]
            back = going[~more]
            if len(back):
                here = last_at[back]
                if here.min() < 0:
                    raise ValueError(f"no encoding of {words[back[here.argmin()]]!r}")
                dead[at[back]] = True
                at[back], left[back], on_path[here] = here, taken[here], False
                last_at[back] = before[here]
                last[back] = np.where(before[here] >= 0, chosen[before[here]], -1)
            going = going[at[going] <= stops[going]]
        places = np.flatnonzero(on_path)
        blob = chosen[places].astype("<u4").tobytes()
        lows, highs = (4 * np.searchsorted(places, x) for x in (firsts, stops + 1))
        out = [blob[lo:hi] for lo, hi in zip(lows.tolist(), highs.tolist(), strict=True)]
        for n in going.tolist():
            out[n] = little_endian(self.word_ids(text[firsts[n] : stops[n]]))
        return out

    # -- decoding ---------------------------------------------------------

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the entries of the ids, joined by one blank, read through the offset table."""
        held = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(held):
            return b""
        out = []
        for at in range(0, len(held), 65536):
            part = held[at : at + 65536]
            start, size = self.offsets[part], self.offsets[part + 1] - self.offsets[part]
            ends = np.cumsum(size)
            index = np.arange(ends[-1]) + np.repeat(start - (ends - size), size)
            out.append(self.blob[index].tobytes())
        return b"".join(out)[:-1]


class _Kept:
    """Ids by text, in two generations of at most ``limit`` texts and one batch."""

    def __init__(self, limit: int):
        self.limit = limit
        self.now: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: Iterable[str]) -> list[str]:
        """Those of ``wanted`` that are in neither generation; what the old one has is brought back."""
        now, old = self.now, self.old
        new = [x for x in wanted if x not in now]
        if not old:
            return new
        none = []
        for x in new:
            ids = old.get(x)
            if ids is None:
                none.append(x)
            else:
                now[x] = ids
        return none

    def settle(self) -> None:
        """Bring the generations to their limit once a batch is done; very long texts are forgotten."""
        if len(self.now) >= self.limit:
            self.old = {text: ids for text, ids in self.now.items() if len(text) <= LONGEST_CACHED}
            self.now = {}


def little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_LOADED: dict[str, BacktrackingBPE] = {}


def load_bpe(path: str) -> BacktrackingBPE:
    """The encoder of a vocabulary file, built once in each process."""
    if path not in _LOADED:
        _LOADED[path] = BacktrackingBPE(path)
        # The tables live as long as the process and hold no cycles; don't walk them again and again.
        gc.collect()
        gc.freeze()
        gc.set_threshold(200_000, 20, 100)
    return _LOADED[path]


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def resolve_vocabulary(given: str | None) -> str:
    """A given path, else the installed vocabulary, looked up where the code runs."""
    return given or vocabulary_path()


def gathered(batches: Iterable[pa.RecordBatch], bpe: BacktrackingBPE) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Identifiers and ids of the rows of several batches at a time: the more texts, the fewer lookups."""
    docs: list[int | None] = []
    texts: list[str | None] = []
    size = 0
    for batch in batches:
        docs += batch["doc_id"].to_pylist()
        texts += batch["text"].to_pylist()
        size += batch["text"].nbytes
        if size >= GATHERED_BYTES:
            yield docs, bpe.encode_all(texts)
            docs, texts, size = [], [], 0
    yield docs, bpe.encode_all(texts)


ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("ids", T.BinaryType()),
        T.StructField("decoded", T.BinaryType()),
    ]
)


def encode_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id``, ids (little-endian unsigned 32-bit) and decoded UTF-8 of each text.

    One output row for each input row, repeated rows included; null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = load_bpe(resolve_vocabulary(vocabulary))
        for docs_, ids in gathered(batches, bpe):
            for at in range(0, len(ids), DECODED_ROWS):
                part = ids[at : at + DECODED_ROWS]
                yield {"doc_id": docs_[at : at + DECODED_ROWS], "ids": part, "decoded": [bpe.decode(x) for x in part]}

    return mapped(docs.select("doc_id", "text"), run, ENCODED)


def encoding_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token counts and SHA-256 digests of the ids and of the decoded text of each row."""
    return encode_decode(docs, vocabulary).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
