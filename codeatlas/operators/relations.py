"""Call relations: target deduplication, resolution of names to symbols, alias closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.shared import stored

def dedupe_targets(refs: DataFrame, source: str = "source_id") -> DataFrame:
    """Each (name, parent) of a source once; names without a parent go where one with a parent exists.

    ``refs``: ``source, target_name, target_parent, ord``.
    """
    scoped = F.max(F.col("target_parent").isNotNull()).over(Window.partitionBy(source, "target_name"))
    kept = refs.withColumn("scoped", scoped).where(F.col("target_parent").isNotNull() | ~F.col("scoped"))
    return kept.groupBy(source, "target_name", "target_parent").agg(F.min("ord").alias("ord"))


def resolve_targets(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbol that each reference means: ``ref_id, source_id, target_id``.

    ``refs``: ``ref_id, source_id, source_file, target_name, target_parent``; ``symbols``: ``id,
    name, parent_name, file_id, path, start_line, exported``. Among symbols of that name those
    with the wanted parent come first, all others only if there are none; then the same file,
    then exported ones, then the first by place. Symbols are reduced to the best one for each name,
    with and without file and parent, before references meet them, so each reference joins at
    most four rows however popular its name is.
    """
    first = F.struct(~F.col("exported"), "path", "start_line", "id")
    named = symbols.select(F.col("name").alias("target_name"), F.col("parent_name").alias("target_parent"), F.col("file_id").alias("source_file"), F.col("id").alias("id"), "path", "start_line", "exported")

    def best(*keys: str) -> DataFrame:
        # Within a file the path is the same, and being exported makes no difference.
        order = F.struct("start_line", "id") if "source_file" in keys else first
        rows = named.where("target_parent is not null") if "target_parent" in keys else named
        return rows.groupBy(*keys).agg(F.min(order)["id"].alias("_".join(["id", *keys])))

    found, choices = refs, []
    for keys in (["target_name", "target_parent", "source_file"], ["target_name", "target_parent"], ["target_name", "source_file"], ["target_name"]):
        found = found.join(best(*keys), keys, "left")
        choices.append("_".join(["id", *keys]))
    return found.select("ref_id", "source_id", F.coalesce(*choices).alias("target_id")).where("target_id is not null")


def alias_closure(edges: DataFrame) -> DataFrame:
    """``name, reach``: every name that a name stands for, itself included.

    ``edges``: ``name, target``, where cycles and self loops may occur. Paths are doubled: a step joins the
    pairs that were new in the last one, whose shortest way is the longest so far, with all known pairs, so
    that rounds grow with the logarithm of the depth. Each step's pairs are written to the shared
    folder, which keeps plans short; the loop ends when there are no new ones.
    """
    cut = lambda df: stored(df, "aliases")[0]
    fresh = cut(edges.select("name", F.col("target").alias("reach")).where("name != reach").distinct())
    names = edges.select("name").union(edges.select("target")).distinct()
    known = cut(names.select("name", F.col("name").alias("reach")).unionByName(fresh))
    while not fresh.isEmpty():
        onward = known.select(F.col("name").alias("reach"), F.col("reach").alias("further"))
        following = fresh.join(onward, "reach").select("name", F.col("further").alias("reach")).distinct()
        fresh = cut(following.join(known, ["name", "reach"], "left_anti"))
        known = cut(known.unionByName(fresh))
    return known
