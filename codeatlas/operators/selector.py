"""Symbol selectors: ``path#Parent.symbol`` as predicates and sort keys over symbols."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeatlas.functions.text import ascii_lower, contains_like


#: Order by place. Where an id has several rows, as it may be that of two symbols or have two parents, what the rows show
#: ends the tie, so that a result doesn't hang on the order in which a join gave them.
BY_PLACE = ("path", "start_line", "id", "kind", "name", "parent_name")


@dataclass(frozen=True)
class Selector:
    symbol: str
    container: str | None = None
    path: str | None = None


def _scoped(text: str) -> tuple[str, str | None]:
    """Symbol and container at the last dot, unless what stands before it is a path."""
    at = text.rfind(".")
    if at <= 0 or at == len(text) - 1:
        return text, None
    container, symbol = text[:at].strip(), text[at + 1 :].strip()
    if not container or not symbol or "/" in container or "\\" in container:
        return text, None
    return symbol, container


def parse_selector(text: str) -> Selector:
    """Split at the last ``#``, then at the last dot; a ``#`` at either end doesn't split."""
    text = text.strip()
    at = text.rfind("#")
    path = None
    if 0 < at < len(text) - 1:
        path, text = text[:at].strip() or None, text[at + 1 :].strip()
    symbol, container = _scoped(text)
    return Selector(symbol, container, path)


def place(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's ``path`` and their parent's ``name`` as ``parent_name``.

    Methods alone have parents, and a parent is a class; both small sides are left to the
    optimizer, which broadcasts them only when their size allows it.
    """
    parents = symbols.select(F.col("id").alias("parent_symbol_id"), F.col("name").alias("parent_name"))
    return symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").join(parents, "parent_symbol_id", "left")


def matches(placed: DataFrame, selector: Selector, exact: bool) -> DataFrame:
    """Placed symbols that satisfy a selector: equal or contained name, equal container, contained path."""
    name = ascii_lower("name")
    symbol = selector.symbol.lower()
    found = name == symbol if exact else contains_like(name, symbol)
    if selector.container:
        found = found & (ascii_lower(F.coalesce("parent_name", F.lit(""))) == selector.container.lower())
    if selector.path:
        found = found & contains_like(ascii_lower("path"), selector.path.lower())
    return placed.where(found)


def order_keys(selector: Selector) -> list[Column]:
    """Exact name, then parent, then path match, exported first, then place; what a row shows ends every tie.

    Without a container, symbols without a parent come first, as an absent parent counts as
    the empty name.
    """
    parent = ascii_lower(F.coalesce("parent_name", F.lit(""))) == (selector.container or "").lower()
    keys = [F.when(ascii_lower("name") == selector.symbol.lower(), 0).otherwise(1), F.when(parent, 0).otherwise(1)]
    if selector.path:
        keys.append(F.when(contains_like(ascii_lower("path"), selector.path.lower()), 0).otherwise(1))
    return [*keys, F.col("exported").desc(), *map(F.col, BY_PLACE)]


def candidates(placed: DataFrame, selector: Selector, limit: int) -> DataFrame:
    """Up to ``limit`` symbols in selector order: exact names, or contained ones where there are none.

    One pass finds both; the sort prefers exact names, and a bounded window over the rows
    that are left drops the others if there was an exact one.
    """
    both = matches(placed, selector, exact=False)
    exact = ascii_lower("name") == selector.symbol.lower()
    # A LIKE with live wildcards always matches the name itself, so exact names are among them.
    top = both.withColumn("exact", exact).orderBy(F.col("exact").desc(), *order_keys(selector)).limit(limit)
    any_exact = F.max("exact").over(Window.partitionBy(F.lit(0)))
    return top.withColumn("any_exact", any_exact).where(F.col("exact") | ~F.col("any_exact")).drop("exact", "any_exact")
