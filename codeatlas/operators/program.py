"""Whole-program facts: imports, exports and declared member types joined across files.

The parser hands on facts by file; here they meet. A name is followed through imports and
re-exports to the file that declares it, and a chain like ``deps.store.save`` from type to type
until its last step names a method and its class. Re-exports and member chains are followed to
their end.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.shared import stored


Keep = Callable[[DataFrame, str], DataFrame]


def in_shared_folder(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]  # without its lineage: plans don't grow with the rounds


def facts(rows: DataFrame, kind: str, **names: str) -> DataFrame:
    """Rows of one kind with readable column names (``a="local"`` and so on) beside ``path`` and ``ord``."""
    return rows.where(F.col("fact") == kind).select("path", "ord", *[F.col(k).alias(v) for k, v in names.items()])


def key_of(path: Column) -> Column:
    """Module key of a path: without suffix; an index file stands for its folder."""
    plain = F.regexp_replace(path, r"\.(tsx|ts|jsx|js)$", "")
    return F.regexp_replace(plain, r"(^|/)index$", "")


def definitions(rows: DataFrame, keep: Keep = in_shared_folder) -> DataFrame:
    """``key, exported, def_key, def_name``: where an exported name of a module is declared.

    Each round follows re-exports of what was new in the last one a step further, until nothing is; ``keep``
    stores a round's rows, as the next one reads them more than once.
    """
    exports = facts(rows, "export", a="exported", b="local", c="module", d="raw").withColumn("key", key_of(F.col("path")))
    imports = facts(rows, "import", a="local", b="original", c="module").where("module is not null and original != '*'").withColumn("key", key_of(F.col("path")))
    own = exports.where("raw is null").select("key", "exported", "local")
    # An exported name that was imported before is a re-export in two steps.
    passed = own.join(imports.select("key", F.col("local"), "module", "original"), ["key", "local"]).select("key", "exported", F.col("module").alias("next"), F.col("original").alias("name"))
    direct = own.join(imports.select("key", "local"), ["key", "local"], "left_anti").select("key", "exported", F.col("key").alias("def_key"), F.col("local").alias("def_name"))
    links = exports.where("raw is not null and module is not null and exported != '*'").select("key", "exported", F.col("module").alias("next"), F.col("local").alias("name")).unionByName(passed)
    stars = exports.where("exported = '*' and module is not null").select("key", F.col("module").alias("next"))
    found = fresh = keep(direct.distinct(), "definitions_0")
    for step in count(1):
        if fresh.isEmpty():
            return found
        known = fresh.select(F.col("key").alias("next"), F.col("exported").alias("name"), "def_key", "def_name")
        named = links.join(known, ["next", "name"]).select("key", "exported", "def_key", "def_name")
        all_ = stars.join(known, "next").where("name != 'default'").select("key", F.col("name").alias("exported"), "def_key", "def_name")
        fresh = keep(named.unionByName(all_).distinct().join(found, ["key", "exported", "def_key", "def_name"], "left_anti"), f"new_definitions_{step}")
        found = keep(found.unionByName(fresh), f"definitions_{step}")


def bindings(rows: DataFrame, defined: DataFrame) -> DataFrame:
    """``path, local, def_key, def_name``: what each imported name of a file stands for."""
    imports = facts(rows, "import", a="local", b="original", c="module").where("module is not null")
    known = defined.select(F.col("key").alias("module"), F.col("exported").alias("original"), "def_key", "def_name")
    return imports.join(known, ["module", "original"]).select("path", "local", "def_key", "def_name").distinct()


def named(rows: DataFrame, keep: Keep = in_shared_folder) -> tuple[DataFrame, DataFrame]:
    """:func:`definitions` and :func:`bindings` of the facts of all files."""
    defined = definitions(rows, keep)
    return defined, keep(bindings(rows, defined), "bindings")


def semantic_refs(rows: DataFrame, keep: Keep = in_shared_folder, names: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``path, source, target_name, target_parent`` that follow from imports and declared types; ``names``: :func:`named`."""
    defined, bound = names or named(rows, keep)
    chains = facts(rows, "chain", a="source", b="root", c="steps").withColumns({"id": F.concat_ws(":", "path", F.lpad(F.col("ord").cast("string"), 9, "0")), "steps": F.filter(F.split("steps", r"\."), lambda x: x != "")})
    # Where the root's type is declared: by the import that binds it, else in the file itself.
    at = chains.join(bound.withColumnRenamed("local", "root"), ["path", "root"], "left").select(
        "id", "path", "source", "steps", F.coalesce("def_key", key_of(F.col("path"))).alias("key"), F.coalesce("def_name", "root").alias("type"), F.col("def_name").isNotNull().alias("bound")
    )
    # A namespace's member is what its module exports under that name.
    spaces = facts(rows, "import", a="root", b="original", c="module").where("module is not null and original = '*'").select("path", "root", "module")
    exported = defined.select(F.col("key").alias("module"), F.col("exported").alias("member"), F.col("def_key").alias("key"), F.col("def_name").alias("type"))
    within = chains.where(F.size("steps") > 0).join(spaces, ["path", "root"]).withColumn("member", F.element_at("steps", 1)).join(exported, ["module", "member"])
    at = at.unionByName(within.select("id", "path", "source", F.expr("slice(steps, 2, size(steps) - 1)").alias("steps"), "key", "type", F.lit(True).alias("bound")))
    called = at.where((F.size("steps") == 0) & F.col("bound")).select("path", "source", F.col("type").alias("target_name"), F.lit(None).cast("string").alias("target_parent"))
    members = facts(rows, "member", a="owner", b="member", c="of")
    placed = members.join(bound.withColumnRenamed("local", "of"), ["path", "of"], "left").select(
        key_of(F.col("path")).alias("key"), F.col("owner").alias("type"), "member", F.coalesce("def_key", key_of(F.col("path"))).alias("next_key"), F.coalesce("def_name", "of").alias("next_type")
    )
    methods = facts(rows, "method", a="type", b="method").select(key_of(F.col("path")).alias("key"), "type", "method").distinct()
    out, now = [called], keep(at.where(F.size("steps") > 0), "chains_0")
    for step in count(1):  # each step takes a member off every chain
        last = now.where(F.size("steps") == 1).withColumn("method", F.element_at("steps", 1))
        out.append(last.join(methods, ["key", "type", "method"]).select("path", "source", F.col("method").alias("target_name"), F.col("type").alias("target_parent")))
        more = now.where(F.size("steps") > 1).withColumn("member", F.element_at("steps", 1))
        now = keep(more.join(placed, ["key", "type", "member"]).select("id", "path", "source", F.expr("slice(steps, 2, size(steps) - 1)").alias("steps"), F.col("next_key").alias("key"), F.col("next_type").alias("type")), f"chains_{step}")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, out).distinct()


def module_edges(rows: DataFrame) -> DataFrame:
    """``path, module``: which files import from or re-export which modules (keys of :func:`key_of`)."""
    imports = facts(rows, "import", c="module").where("module is not null").select("path", "module")
    exports = facts(rows, "export", c="module").where("module is not null").select("path", "module")
    return imports.union(exports).distinct()


def dependent_files(edges: DataFrame, paths: DataFrame, keep: Keep = in_shared_folder) -> DataFrame:
    """``paths`` (``path``) and all files that import from them, directly or by way of others."""
    links = edges.withColumnRenamed("path", "by")
    return _reached(paths, lambda new: links.join(new.select(key_of(F.col("path")).alias("module")).distinct(), "module").select(F.col("by").alias("path")), keep, "dependents")


def needed_files(edges: DataFrame, files: DataFrame, paths: DataFrame, keep: Keep = in_shared_folder) -> DataFrame:
    """``paths`` and all of ``files`` that they import from, directly or by way of others."""
    keys = files.select(key_of(F.col("path")).alias("module"), F.col("path").alias("of"))
    return _reached(paths, lambda new: new.join(edges, "path").select("module").distinct().join(keys, "module").select(F.col("of").alias("path")), keep, "needed")


def _reached(paths: DataFrame, step: Callable[[DataFrame], DataFrame], keep: Keep, name: str) -> DataFrame:
    found = fresh = keep(paths.select("path").distinct(), f"{name}_0")
    for n in count(1):
        fresh = keep(step(fresh).distinct().join(found, "path", "left_anti"), f"{name}_new_{n}")
        if fresh.isEmpty():
            return found
        found = keep(found.unionByName(fresh), f"{name}_{n}")
