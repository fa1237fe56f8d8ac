"""Best-fit packing by minimum bin slack.

Texts become token ids plus an end id; only those longer than a sequence are cut. Packing
works on the histogram of piece lengths, which has at most ``capacity`` entries whatever the
size of the corpus. For each bin the longest length still available is placed first, and a
bitset subset-sum over the others finds the fullest feasible combination. That combination is
removed as often as the histogram allows, so the plan has few distinct bins. Pieces then find
their place by their ordinal within their length; no group of pieces meets in one task.

Edge cases: null and empty texts are one piece holding the end id alone; repeated rows, and rows
with a null or repeated ``doc_id``, are packed as often as they come, each of them by itself;
among pieces of equal length any may take a place, but once they are stored the places don't
change; an empty table gives an empty one; very long texts are cut into as many pieces as they
need; columns other than ``doc_id`` and ``text`` are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.bpe import gathered, load_bpe, resolve_vocabulary
from codeatlas.llm.common import mapped, shuffle_partitions, stored

CAPACITY = 4096
END_ID = 1


def fullest(counts: dict[int, int], lengths: list[int], target: int) -> dict[int, int]:
    """The combination of available lengths whose sum is largest but at most ``target``.

    ``lengths`` are the keys of ``counts`` in descending order. Bit ``s`` of the bitset says
    that sum ``s`` can be reached; a length with several copies enters in powers of two.
    """
    reach, window, layers = 1, (1 << (target + 1)) - 1, []
    for length in lengths:
        copies, step = min(counts[length], target // length), 1
        while copies > 0:
            take = min(step, copies)
            layers.append((length, take, reach))
            reach |= (reach << (take * length)) & window
            copies -= take
            step *= 2
        if reach >> target & 1:
            break
    left = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(layers):
        if not before >> left & 1:
            left -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def slack_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (copies of each length, how many such bins), fullest first for each longest piece."""
    counts = {n: c for n, c in histogram.items() if c}
    plan = []
    while counts:
        lengths = sorted(counts, reverse=True)
        first = lengths[0]
        counts[first] -= 1
        usable = [n for n in lengths if n <= capacity - first and counts[n]]
        chosen = fullest(counts, usable, capacity - first) if usable else {}
        counts[first] += 1
        chosen[first] = chosen.get(first, 0) + 1
        bins = min(counts[n] // k for n, k in chosen.items())
        plan.append((chosen, bins))
        for n, k in chosen.items():
            counts[n] -= bins * k
            if not counts[n]:
                del counts[n]
    return plan


def placement(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ordinals: pieces are numbered by length, then by ordinal.

    ``length`` and ``base`` give the first number of each length; the other arrays have a row
    for each (bin kind, length): first number, copies in a bin, first bin and offset.
    """
    rows, seen, sequence = [], {}, 0
    for chosen, bins in plan:
        offset = 0
        for n, k in sorted(chosen.items(), reverse=True):
            rows.append((n, seen.get(n, 0), k, sequence, offset))
            seen[n] = seen.get(n, 0) + bins * k
            offset += n * k
        sequence += bins
    rows.sort()
    length = np.array(sorted(seen), dtype=np.int64)
    base = np.concatenate([[0], np.cumsum([seen[n] for n in length])])[:-1].astype(np.int64)
    starts = dict(zip(length.tolist(), base.tolist(), strict=True))
    table = np.array([(starts[n] + lo, k, seq, off) for n, lo, k, seq, off in rows], dtype=np.int64).reshape(-1, 4)
    return {"length": length, "base": base, "first": table[:, 0], "copies": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of each row, with a checksum of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        bpe = load_bpe(resolve_vocabulary(vocabulary))
        end, width = end_id.to_bytes(4, "little"), 4 * capacity
        for held in gathered(batches, bpe):
            rows = []
            for doc, encoded in zip(*held, strict=True):
                ids = encoded + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield rows

    return mapped(docs.select("doc_id", "text"), run, PIECES)


PACKED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece of ``cut`` (columns of :data:`PIECES`) a sequence and a place in it."""
    spark = cut.sparkSession
    salts = max(8, shuffle_partitions(spark))
    # A number of its own for each row, fixed by storing it: repeated or missing ids don't meet in one salt.
    numbers = cut.withColumn("row", F.monotonically_increasing_id())
    held, _ = stored(numbers.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))), "pieces")
    sums = held.groupBy("length", "salt").count()
    # At most ``capacity`` rows reach the driver, whatever the size of the corpus.
    histogram = {int(r[0]): int(r[1]) for r in sums.groupBy("length").agg(F.sum("count")).collect()}
    where = placement(slack_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("row")
    numbered = (
        held.withColumn("nth", F.row_number().over(within) - 1)
        .join(starts, ["length", "salt"])
        .select(*PIECES.names, (F.col("before") + F.col("nth")).alias("ordinal"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            lengths, ordinal = batch["length"].to_numpy(), batch["ordinal"].to_numpy()
            number = where["base"][np.searchsorted(where["length"], lengths)] + ordinal
            row = np.searchsorted(where["first"], number, side="right") - 1
            nth = number - where["first"][row]
            copies = where["copies"][row]
            places = {"sequence_id": where["sequence"][row] + nth // copies, "offset": where["offset"][row] + nth % copies * lengths}
            yield {name: batch[name] for name in PIECES.names} | places

    return mapped(numbered, run, PACKED)


def best_fit_pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Cut and pack all texts of ``docs`` (``doc_id``, ``text``); one row for each piece."""
    return pack(pieces(docs, vocabulary, capacity, end_id), capacity)
