"""URL verdicts: rules on host and path, then trust and distrust over the link graph of hosts.

Links between pages become weighted edges between hosts. Trust starts at hosts most of whose
pages a rule allows and flows along links (personalised PageRank); distrust starts at hosts
most of whose pages a rule blocks and flows against the links, to those that point there.
Where no rule fits a page, it is blocked if its host's distrust exceeds the given multiple of
its trust.

Scores of a side add up to one: what reaches a host without links goes back to the seeds. As that
only scales all scores of a side alike, it is done once at the end.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule and no
links; rows with null html have no links; repeated rows and rows with a null or repeated
``page_id`` are judged each; hosts that nothing reaches score 0 on both sides and equal scores
allow; an empty table gives an empty one; urls and pages of any length are read whole; columns
other than ``page_id``, ``url`` and ``html`` are not read, whatever their names.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.llm.common import drop_path, shared_dir, shuffle_partitions, stored

#: The rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
#: A host is a seed if a rule gives more than this share of its pages the same verdict.
SEED_SHARE = 0.5
#: Rounds end when no host's score moves by more than this share of itself.
TOLERANCE = 1e-7
#: Rounds between two looks at what has moved.
LOOK = 4
FACTOR = 1.0
#: Distrust must exceed trust by this share of it; what is left after the last round lies below.
MARGIN = 1e-6

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise("")


def host_and_path(rows: DataFrame, url: str) -> DataFrame:
    """``rows`` with columns ``host`` and ``path`` of column ``url``."""
    rest = rows.withColumn("__url", F.coalesce(F.col(url), F.lit(""))).withColumn("__rest", _after_scheme(F.col("__url")))
    host = F.translate(F.regexp_extract("__rest", r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return rest.withColumns({"host": host, "path": F.regexp_extract("__rest", r"^[^/?#]*([^?#]*)", 1)}).drop("__url", "__rest")


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for what, at, below in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(below)
        name, verdict = F.when(fits, F.lit(at + below)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts, summed up."""
    links = pages.select("url", F.explode(F.expr(r"regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*[\"\']?([^\"\'\\s>]+)', 1)")).alias("link"))
    absolute = links.withColumn("link", F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))).where(F.instr("link", "://") > 0)
    ends = host_and_path(absolute, "url").select(F.col("host").alias("src"), "link")
    both = host_and_path(ends, "link").select("src", F.col("host").alias("dst"))
    return both.where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank for several sides at once.

    ``edges``: ``side, src, dst, share`` with shares summing to at most 1 for each source;
    ``seeds``: ``side, host, weight``. Every round is written to the shared folder, with the score before it
    beside each new one; every ``LOOK`` rounds these are compared, and rounds end when no score moves by more than ``tolerance`` times itself and no host is new, so that
    neither the number of seeds nor the distance from them decides who gets a score.
    """
    spark = edges.sparkSession
    base = seeds.select("side", "host", (F.col("weight") * (1 - damping)).alias("score"))
    now, path = stored(base, "ranks")
    none = F.lit(0.0)
    for number in count(1):
        sent = edges.join(now.select("side", F.col("host").alias("src"), "score"), ["side", "src"]).select("side", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        given = sent.unionByName(base).withColumn("old", none).unionByName(now.select("side", "host", none.alias("score"), F.col("score").alias("old")))
        after, new_path = stored(given.groupBy("side", "host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")), "ranks")
        drop_path(spark, path)
        now, path = after.select("side", "host", "score"), new_path
        if number % LOOK == 0:
            moved = after.agg(F.max(F.when(F.col("score") > 0, F.abs(F.col("score") - F.col("old")) / F.col("score")))).first()[0]
            if (moved or 0.0) < tolerance:
                break
    # Two rows: the sums of the sides.
    return now.join(F.broadcast(now.groupBy("side").agg(F.sum("score").alias("whole"))), "side").select("side", "host", (F.col("score") / F.col("whole")).alias("score"))


@contextlib.contextmanager
def clustered(edges: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """``edges`` as a table in buckets of ``keys``, so that rounds of joins don't shuffle it again."""
    spark = edges.sparkSession
    path = shared_dir(spark, "ways")
    name = "ways_" + path.rpartition("-")[2]
    edges.write.option("path", path).bucketBy(shuffle_partitions(spark), *keys).sortBy(*keys).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(spark, path)


def host_scores(pages: DataFrame, rules=RULES) -> DataFrame:
    """``host, trust, distrust`` of every host that a seed reaches."""
    placed = host_and_path(pages.select("url"), "url").where("host != ''")
    judged = placed.select("host", rule_of(F.col("host"), F.col("path"), rules)[1].alias("verdict"))
    share = lambda what: F.count_if(F.col("verdict") == what) / F.count("*")
    counts = judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    shares = counts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("side", "weight")).where(F.col("weight") > SEED_SHARE)
    seeds, seed_path = stored(shares, "seeds")
    # Two rows: the sums of the sides.
    seeds = seeds.join(F.broadcast(seeds.groupBy("side").agg(F.sum("weight").alias("whole"))), "side").select("side", "host", (F.col("weight") / F.col("whole")).alias("weight"))
    links, link_path = stored(host_edges(pages), "links")
    ways = links.select(F.lit("trust").alias("side"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = ways.groupBy("side", "src").agg(F.sum("n").alias("whole"))
    edges = ways.join(out, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("whole")).alias("share"))
    with clustered(edges, "side", "src") as table:
        ranks = propagate(table, seeds)
        ranks, _ = stored(ranks, "ranks")
    for path in (seed_path, link_path):
        drop_path(pages.sparkSession, path)
    side = lambda name: F.sum(F.when(F.col("side") == name, F.col("score")).otherwise(0.0)).alias(name)
    return ranks.groupBy("host").agg(side("trust"), side("distrust"))


def judge(pages: DataFrame, rules=RULES, factor: float = FACTOR) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of each row of ``pages``."""
    scores, _ = stored(host_scores(pages, rules), "scores")
    rows = host_and_path(pages.select("page_id", "url"), "url")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    trust, distrust = (F.coalesce(x, F.lit(0.0)) for x in ("trust", "distrust"))
    own = F.when(distrust > trust * factor * (1 + MARGIN), "block").otherwise("allow")
    return rows.join(scores, "host", "left").select(
        "page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
