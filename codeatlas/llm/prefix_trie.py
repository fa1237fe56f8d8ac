"""Prefix trie of conversations, built level by level.

A node stands for the conversations that begin with the same turns (role and text) and is named
by its depth and the least ``conv_id`` among them. Down: at each depth, live conversations are grouped
by the node they are at and their next turn; a group is a child, and its least ``conv_id`` its name.
A conversation that is alone in its node meets no other any more and leaves: the rest of its path needs
no grouping. Rounds end when nobody is live, so there is one for each depth that two conversations
share. Up: level by level, children hand leaves and savings to their parents.

Turns travel as SHA-256 digests. Groups are counted before anything is shuffled, and the tables of
groups are read from storage when live conversations join them, so that Spark may split a hot one.
Positions of turns come from one global order, so a conversation with very many turns is no single
task's work. Ids that end at a node are joined into pieces in their global order, and one
stream over a node's pieces takes their digest.

Edge cases: rows with a null ``conv_id`` belong to no conversation and are left out; null roles and
texts are empty; turns come by ``turn`` (null first), then role, then text, and repeated rows are turns
of their own; conversations without turns are members of the root alone; an empty table has no
node, not even a root; texts are read whole; columns other than the four are not read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeatlas.llm.common import drop_path, mapped, shared_dir, stored
from codeatlas.operators.ids import numbered

#: Ids in a piece of a digest's input.
PIECE_IDS = 4096
#: Base conversations and how many of their turns others begin with, in the registered query's rule.
EVERY, MOST_GIVEN = 100, 5


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id, pos, role, text`` with ``pos`` from 1, and ``conv_id, n_turns`` of each conversation."""
    spark = turns.sparkSession
    empty = F.lit("")
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    stage = shared_dir(spark, "turns")
    dense, _ = stored(numbered(rows, ["conv_id", "turn", "role", "text"], 0, stage, "nth"), "numbered")
    drop_path(spark, stage)
    firsts, _ = stored(dense.groupBy("conv_id").agg(F.min("nth").alias("first"), F.count("*").alias("n_turns")), "firsts")
    placed = dense.join(firsts, "conv_id").select("conv_id", (F.col("nth") - F.col("first") + 1).alias("pos"), "role", "text")
    return placed, firsts.select("conv_id", "n_turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of a base conversation, in the form of :func:`positions`.

    Conversation c takes the first h = crc32(c) % 6 turns of conversation c - c % 100, as far as there
    are any, and goes on with its own turns after its first h.
    """
    placed, sizes = positions(turns)
    placed, _ = stored(placed, "placed")
    asked = sizes.select("conv_id", "n_turns", (F.crc32(F.col("conv_id").cast("string")) % (MOST_GIVEN + 1)).alias("h"), (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"))
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("there"))
    plan, _ = stored(
        asked.join(bases, "base", "left").select("conv_id", "base", "h", "n_turns", F.least("h", F.coalesce("there", F.lit(0))).alias("given")),
        "plan",
    )
    heads = placed.where(F.col("pos") <= MOST_GIVEN).withColumnRenamed("conv_id", "base").join(plan, "base").where("pos <= given").select("conv_id", "pos", "role", "text")
    own = placed.join(plan, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"), "role", "text")
    left = F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    return heads.unionByName(own), plan.select("conv_id", (F.col("given") + left).alias("n_turns"))


PIECES = T.StructType([T.StructField("depth", T.LongType()), T.StructField("conv_id", T.LongType()), T.StructField("first", T.LongType()), T.StructField("ids", T.StringType())])
DIGESTS = T.StructType([T.StructField("depth", T.LongType()), T.StructField("conv_id", T.LongType()), T.StructField("ends_sha256", T.StringType())])


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """``depth, conv_id, ends_sha256`` from ``depth, node, member``: the digest of a node's members in rising order."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        node, ids = None, []
        for batch in batches:
            out = []
            for depth, name, member in zip(*(batch[c].to_pylist() for c in ("depth", "node", "member")), strict=True):
                if (depth, name) != node or len(ids) == PIECE_IDS:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = (depth, name), []
                ids.append(member)
            yield out
        if ids:
            yield [(*node, ids[0], ",".join(map(str, ids)))]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        node, state = None, None
        for batch in batches:
            out = []
            for depth, name, ids in zip(*(batch[c].to_pylist() for c in ("depth", "conv_id", "ids")), strict=True):
                if (depth, name) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (depth, name), hashlib.sha256(ids.encode())
            yield out
        if node is not None:
            yield [(*node, state.hexdigest())]

    order = ("depth", "node", "member")
    cut = mapped(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), pieces, PIECES)
    return mapped(cut.repartition("depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first"), digests, DIGESTS)


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``turns``: ``conv_id, pos, role, text`` with ``pos`` from 1 without gaps; ``convs``: ``conv_id, n_turns`` of
    each conversation, those without turns too.
    """
    spark = turns.sparkSession
    convs, _ = stored(convs, "convs")
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    keyed, _ = stored(
        turns.join(convs, "conv_id").select("conv_id", "pos", F.unhex(key).alias("key"), F.length("text").cast("long").alias("size"), "n_turns").sortWithinPartitions("pos"),
        "keyed",
    )
    root, members = convs.agg(F.min("conv_id"), F.count("*")).first()

    top = convs.agg(F.lit(None).cast("long").alias("node"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("size"), F.max("n_turns").alias("n_turns"))
    levels = [top.where("n_convs > 0")]
    live, _ = stored(convs.select("conv_id", F.lit(root).cast("long").alias("node"), "n_turns").where(F.lit(members > 1)), "live")
    ends = []
    while not live.isEmpty():
        depth = len(levels)
        ends.append(live.where(F.col("n_turns") == depth - 1).select(F.lit(depth - 1).cast("long").alias("depth"), "node", F.col("conv_id").alias("member")))
        at, at_path = stored(keyed.where(F.col("pos") == depth).join(live.select("conv_id", "node"), "conv_id"), "at")
        groups = at.groupBy("node", "key").agg(F.min("conv_id").alias("name"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("n_turns").alias("n_turns"))
        groups, _ = stored(groups, "groups")
        levels.append(groups.select("node", F.col("name").alias("conv_id"), "n_convs", "size", "n_turns"))
        met = groups.where("n_convs > 1").select("node", "key", "name")
        live, _ = stored(at.join(met, ["node", "key"]).select("conv_id", F.col("name").alias("node"), "n_turns"), "live")
        drop_path(spark, at_path)

    # Upwards: leaves and savings of the level below, summed for each parent.
    done, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth].withColumn("own", (F.col("n_convs") - 1) * F.col("size"))
        if below is None:
            counts = level.withColumn("children", F.lit(0).cast("long")).withColumn("leaves", F.lit(0).cast("long")).withColumn("saved", F.lit(0).cast("long"))
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            counts = level.join(sums, "conv_id", "left")
        alone = F.col("n_convs") == 1
        none = F.lit(0).cast("long")
        children = F.when(alone, (F.col("n_turns") > depth).cast("long")).otherwise(F.coalesce("children", none))
        below, _ = stored(
            counts.select(
                "conv_id",
                F.lit(depth).cast("long").alias("depth"),
                F.col("node").alias("parent_conv_id"),
                "n_convs",
                children.alias("n_children"),
                F.greatest(F.coalesce("leaves", none), F.lit(1).cast("long")).alias("n_leaves"),
                (F.col("own") + F.coalesce("saved", none)).alias("saved_tokens"),
                "n_turns",
            ),
            "level",
        )
        done.append(below)
    tops = done[0]
    for level in done[1:]:
        tops = tops.unionByName(level)

    # The rest of the path of a conversation that is alone from some depth on.
    lone = tops.where("n_convs = 1").select("conv_id", F.col("depth").alias("from"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    tails = keyed.join(lone, "conv_id").where(F.col("pos") > F.col("from"))
    tails = tails.select("conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("n_turns") > F.col("pos")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), "n_turns")

    nodes = tops.unionByName(tails)
    ended = F.when((F.col("n_convs") == 1) & (F.col("n_turns") == F.col("depth")), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.sha2(F.lit(""), 256))
    if ends:
        every = ends[0]
        for some in ends[1:]:
            every = every.unionByName(some)
        digests, _ = stored(digests_of_ends(every), "ends")
        nodes = nodes.join(digests, ["depth", "conv_id"], "left")
        ended = F.coalesce("ends_sha256", ended)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ended.alias("ends_sha256"))


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with role and text of each node's last turn (null for the root)."""
    last = turns.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    return nodes.join(last, ["conv_id", "depth"], "left")
