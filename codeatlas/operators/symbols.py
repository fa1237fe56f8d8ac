"""Symbol lookup and one-hop call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.text import ascii_lower
from codeatlas.operators.names import NameIndex, contained, like, literal
from codeatlas.operators.selector import BY_PLACE, Selector, candidates, order_keys, parse_selector, place
from codeatlas.shared import stored

LOOKUP_LIMIT, GRAPH_LIMIT, MATCHED_LIMIT = 10, 20, 10


def lookup(symbols: DataFrame, files: DataFrame, selector: str | Selector, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Where a symbol is defined."""
    selector = parse_selector(selector) if isinstance(selector, str) else selector
    return _shown(candidates(place(symbols, files), selector, limit), selector)


def lookup_stored(index: NameIndex, selector: str | Selector, limit: int = LOOKUP_LIMIT) -> DataFrame:
    """Rows of :func:`lookup`, reading only symbols whose name contains the one that is asked for."""
    selector = parse_selector(selector) if isinstance(selector, str) else selector
    placed = index.symbols_like(selector.symbol.lower()).drop("bucket", "folded")
    return _shown(candidates(placed, selector, limit), selector)


def _shown(hits: DataFrame, selector: Selector) -> DataFrame:
    return hits.orderBy(*order_keys(selector)).select(
        F.col("path").alias("file_path"),
        F.col("name").alias("symbol_name"),
        "kind",
        "start_line",
        "end_line",
        "exported",
        F.col("parent_name").alias("parent_symbol_name"),
    )


def _neighbours(symbols: DataFrame, files: DataFrame, relations: DataFrame, selector: str | Selector, limit: int, side: str) -> DataFrame:
    selector = parse_selector(selector) if isinstance(selector, str) else selector
    anchor, other = ("target_symbol_id", "source_symbol_id") if side == "caller" else ("source_symbol_id", "target_symbol_id")
    placed = place(symbols, files)
    matched = candidates(placed, selector, MATCHED_LIMIT).select(F.col("id").alias(anchor))
    # At most MATCHED_LIMIT ids, so this side is always small enough to broadcast.
    edges = relations.join(F.broadcast(matched), anchor, "left_semi").select(F.col(other).alias("id"), "relation_type")
    hits = placed.join(edges, "id").select("name", "kind", "parent_name", "path", "start_line", "end_line", "relation_type", "id")
    top = hits.orderBy(*BY_PLACE).limit(limit)
    # The limit comes before the deduplication, so fewer than ``limit`` rows may come back.
    key = ("name", "kind", "parent_name", "path", "start_line", "end_line", "relation_type")
    first = top.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where("nth = 1")
    return first.orderBy(*BY_PLACE).select(
        F.col("name").alias(f"{side}_symbol_name"),
        F.col("kind").alias(f"{side}_kind"),
        F.col("parent_name").alias(f"{side}_parent_symbol_name"),
        F.col("path").alias("file_path"),
        "start_line",
        "end_line",
        "relation_type",
    )


def callers(symbols: DataFrame, files: DataFrame, relations: DataFrame, selector: str | Selector, limit: int = GRAPH_LIMIT) -> DataFrame:
    """Who calls a symbol: at most ``limit`` edges, then each caller once."""
    return _neighbours(symbols, files, relations, selector, limit, "caller")


def callees(symbols: DataFrame, files: DataFrame, relations: DataFrame, selector: str | Selector, limit: int = GRAPH_LIMIT) -> DataFrame:
    """What a symbol calls: at most ``limit`` edges, then each callee once."""
    return _neighbours(symbols, files, relations, selector, limit, "callee")


# -- many selectors in one job ------------------------------------------------


def parse_selectors(queries: DataFrame) -> DataFrame:
    """``qid, selector`` with ``symbol, container, path_hint`` parsed as columns."""
    text = F.trim("selector")
    last = F.length(text) - F.instr(F.reverse(text), "#") + 1
    split = (F.instr(text, "#") > 0) & (last > 1) & (last < F.length(text))
    path = F.when(split, F.trim(F.substring(text, F.lit(1), last - 1)))
    rest = F.when(split, F.trim(F.substring(text, last + 1, F.length(text)))).otherwise(text)
    dot = F.length(rest) - F.instr(F.reverse(rest), ".") + 1
    container = F.trim(F.substring(rest, F.lit(1), dot - 1))
    symbol = F.trim(F.substring(rest, dot + 1, F.length(rest)))
    scoped = (F.instr(rest, ".") > 0) & (dot > 1) & (dot < F.length(rest)) & (container != "") & (symbol != "") & ~container.rlike(r"[/\\]")
    return queries.select(
        "qid",
        F.lower(F.when(scoped, symbol).otherwise(rest)).alias("symbol"),
        F.lower(F.when(scoped, container)).alias("container"),
        F.lower(F.nullif(path, F.lit(""))).alias("path_hint"),
    )


def _fitting(rows: DataFrame) -> DataFrame:
    """Rows whose path is one that their selector asks for."""
    return rows.where(F.col("path_hint").isNull() | like(ascii_lower("path"), F.col("path_hint")))


_ASKED = ("symbol", "container", "path_hint")


def _ranked(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` symbols of each thing asked, with their place."""
    top_level = F.when(F.col("folded_parent") == F.coalesce("container", F.lit("")), 0).otherwise(1)
    order = Window.partitionBy(*_ASKED).orderBy(top_level, F.col("exported").desc(), *BY_PLACE)
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)


def _wild(placed: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """Symbols for terms of wildcards alone, which any name fits that has as many characters as they have ``_``."""
    long = lambda rows: rows.where(F.length("folded") >= F.col("least"))
    asked = asked.withColumn("least", F.length(F.replace("symbol", F.lit("%"), F.lit(""))))
    scoped = _fitting(long(placed.join(asked.where("container is not null"), F.col("folded_parent") == F.col("container"))))
    # A path is compared once for each file and hint.
    hinted = asked.where("container is null and path_hint is not null")
    paths = placed.select("path").distinct().join(hinted.select("path_hint").distinct(), like(ascii_lower("path"), F.col("path_hint")))
    hinted = long(placed.join(paths, "path").join(hinted, "path_hint"))
    # Without container and hint the best few names of each length are enough: all terms have the same order.
    order = Window.partitionBy(F.length("folded")).orderBy(F.when(F.col("folded_parent") == "", 0).otherwise(1), F.col("exported").desc(), *BY_PLACE)
    best = placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).drop("nth")
    bare = best.join(asked.where("container is null and path_hint is null"), F.length("folded") >= F.col("least"))
    columns = [*placed.columns, *_ASKED]
    return scoped.select(*columns).unionByName(hinted.select(*columns)).unionByName(bare.select(*columns))


def lookup_batch(symbols: DataFrame, files: DataFrame, queries: DataFrame, limit: int = LOOKUP_LIMIT, index: NameIndex | None = None) -> DataFrame:
    """Lookup of many selectors: exact names, or contained ones for selectors without; then top-k by query.

    What is asked more than once is looked up once. Where a container is given, symbols are met by name and
    parent together, so a method name that many classes share costs a selector no more than another. What
    the exact join finds is stored: it is read again to tell which selectors need the fallback. With an ``index`` of
    the same symbols contained names come from its substrings, else these are made of all names.
    """
    parsed, _ = stored(parse_selectors(queries), "selectors")
    asked = parsed.select(*_ASKED).distinct()
    placed = place(symbols, files).withColumns({"folded": ascii_lower("name"), "folded_parent": ascii_lower(F.coalesce("parent_name", F.lit("")))})
    columns = [*placed.columns, *_ASKED]

    def named(wanted: DataFrame) -> DataFrame:
        """Symbols with the name (``folded``) and the parent that are wanted."""
        scoped = placed.join(wanted.where("container is not null").withColumn("folded_parent", F.col("container")), ["folded", "folded_parent"])
        bare = placed.join(wanted.where("container is null"), "folded")
        return _fitting(scoped.select(*columns).unionByName(bare.select(*columns)))

    found, _ = stored(_ranked(named(asked.withColumn("folded", F.col("symbol"))), limit), "exact")
    loose, _ = stored(asked.join(found.where("nth = 1").select(*[F.col(c).alias(f"met_{c}") for c in _ASKED]), [F.col(c).eqNullSafe(F.col(f"met_{c}")) for c in _ASKED], "left_anti"), "loose")
    if not loose.isEmpty():
        wild = literal(F.col("symbol")) == ""
        terms = loose.where(~wild).select("symbol").distinct()
        pairs = index.contained(terms) if index else contained(placed.select("folded").distinct(), terms)
        near = named(loose.where(~wild).join(pairs, "symbol")).unionByName(_wild(placed, loose.where(wild), limit))
        found = found.unionByName(_ranked(near, limit))
    met = [found[c].eqNullSafe(parsed[c]) if c != "symbol" else found[c] == parsed[c] for c in _ASKED]
    return parsed.join(found, met).select("qid", *[found[c] for c in placed.columns], *[parsed[c] for c in _ASKED], "nth")


def callers_batch(symbols: DataFrame, files: DataFrame, relations: DataFrame, queries: DataFrame, limit: int = GRAPH_LIMIT, side: str = "caller") -> DataFrame:
    """Callers (or callees) of many selectors in one job: joins on symbol ids, top-k by query."""
    anchor, other = ("target_symbol_id", "source_symbol_id") if side == "caller" else ("source_symbol_id", "target_symbol_id")
    matched = lookup_batch(symbols, files, queries, MATCHED_LIMIT).select("qid", F.col("id").alias(anchor))
    edges = relations.join(matched, anchor).select("qid", F.col(other).alias("id"), "relation_type")
    hits = edges.join(place(symbols, files), "id")
    ranked = hits.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy(*BY_PLACE))).where(F.col("nth") <= limit)
    key = ("qid", "name", "kind", "parent_name", "path", "start_line", "end_line", "relation_type")
    return ranked.groupBy(*key).agg(F.min("nth").alias("nth"))
