"""Types of values by inference: what calls like ``make().run()`` and ``box.get().run()`` mean.

The parser hands on three sorts of facts. A *typed* fact declares the type of a slot, which is the
value of a variable, parameter or property, or what a function or method gives back. An *inferred*
fact says that a slot has the type of an expression, or that a body calls the last member of one. A
*super* fact names what a class extends. An expression is a root and a list of steps.

Expressions are evaluated together, by rounds of joins. A *state* is an expression at some type
with the steps that are left; it asks for the slot of its next step in that type's class. A slot's
type may be declared, or come from another expression that is evaluated in the same rounds.
Each round joins new states with all known slots, and waiting ones with new slots only, and ends the
fixpoint when neither is new. Types are terms with arguments, so type parameters take the arguments
of the type or call they belong to.

A term is JSON: ``{"h": "module|Name", "a": [terms]}``, or ``{"p": n}`` and ``{"f": n}`` for the n-th type
parameter of the class and of the function. Terms of more than ``LONGEST`` characters aren't followed: only
types that nest into themselves without end grow that far. Type arguments aren't guessed from values.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeatlas.operators.program import Keep, facts, in_shared_folder, key_of
from codeatlas.operators.program import named as program_names

LONGEST = 2000
_TERM = "h string, a array<string>"
_STEPS = "array<struct<m: string, c: boolean, t: array<string>>>"
_SLOT = ("key", "owner", "name", "slot")


def resolved(rows: DataFrame, columns: list[str], bound: DataFrame) -> DataFrame:
    """``rows`` (``id, path`` and others) with the names in their terms as ``module|Name``."""
    text = F.concat_ws(" ", *columns)
    names = rows.select("id", "path", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r'"h":"([A-Za-z_$][^"|]*)"'), 1))).alias("local"))
    known = names.join(bound, ["path", "local"], "left").select(
        "id", F.struct(F.col("local"), F.concat_ws("|", F.coalesce("def_key", key_of(F.col("path"))), F.coalesce("def_name", "local")).alias("full")).alias("pair")
    )
    # As many names as one expression holds.
    pairs = known.groupBy("id").agg(F.collect_set("pair").alias("pairs"))
    head = lambda name: F.concat(F.lit('"h":"'), name, F.lit('"'))
    full = lambda c: F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<local: string, full: string>>")), F.col(c), lambda acc, p: F.replace(acc, head(p["local"]), head(p["full"])))
    return rows.join(pairs, "id", "left").withColumns({c: full(c) for c in columns}).drop("pairs")


def filled(term: Column, mark: str, arguments: Column) -> Column:
    """``term`` with its parameters of one sort replaced; parameters inside the arguments stay as they are."""
    hole = lambda m, n: F.concat(F.lit(f'{{"{m}":'), n, F.lit("}"))
    opened = F.replace(term, F.lit(f'{{"{mark}":'), F.lit(f'{{"{mark}{mark}":'))
    places = F.transform(F.coalesce(arguments, F.array().cast("array<string>")), lambda x, i: F.struct(i.cast("string").alias("i"), x.alias("x")))
    return F.aggregate(places, opened, lambda acc, p: F.replace(acc, hole(mark * 2, p["i"]), p["x"]))


def _at(states: DataFrame) -> DataFrame:
    """States with the parts of their term; those without a type end here."""
    parts = states.withColumn("parts", F.from_json("term", _TERM)).where("parts.h is not null and length(term) <= %d" % LONGEST)
    return parts.withColumns({"key": F.substring_index("parts.h", "|", 1), "owner": F.substring_index("parts.h", "|", -1), "args": F.col("parts.a")}).drop("parts")


def inferred_refs(rows: DataFrame, keep: Keep = in_shared_folder, names: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``path, source, target_name, target_parent`` of calls whose owner's type follows from values.

    ``rows``: facts of all files; ``names``: what :func:`named` makes of them, where it is there.
    """
    calls = "path string, source string, target_name string, target_parent string"
    if rows.where("fact = 'infer' and a = 'call:'").isEmpty():
        return rows.sparkSession.createDataFrame([], calls)
    defined, bound = names or program_names(rows, lambda df, name: keep(df, f"types_{name}"))
    number = lambda kind: F.concat_ws(":", F.lit(kind), "path", "ord")

    typed = resolved(facts(rows, "typed", a="owner", b="name", c="slot", d="term").withColumn("id", number("t")), ["term"], bound)
    known = typed.select(key_of(F.col("path")).alias("key"), "owner", "name", "slot", "term").distinct()
    supers = resolved(facts(rows, "super", a="owner", b="base").withColumn("id", number("s")), ["base"], bound)
    supers = keep(supers.select(key_of(F.col("path")).alias("key"), "owner", "base").distinct(), "types_supers")
    methods = facts(rows, "method", a="owner", b="name").select(key_of(F.col("path")).alias("key"), "owner", "name").distinct()
    own = keep(methods.unionByName(known.where("owner != ''").select("key", "owner", "name")).distinct(), "types_members")
    methods = keep(methods, "types_methods")

    found = resolved(facts(rows, "infer", a="goal", b="target", c="root", d="steps").withColumn("id", number("i")), ["root", "steps"], bound)
    root = F.from_json("root", "s string, t string, v string, n string")
    found = keep(found.select("id", "path", "goal", "target", root.alias("root"), F.from_json("steps", _STEPS).alias("steps")), "types_expressions")
    goals = found.select("id", "path", F.substring_index("goal", ":", 1).alias("slot"), F.expr("substring(goal, instr(goal, ':') + 1)").alias("owner"), "target")
    goals = keep(goals, "types_goals")
    none = F.array().cast("array<string>")
    rest = F.expr("slice(steps, 2, greatest(size(steps) - 1, 0))")
    here = key_of(F.col("path"))

    # Roots: a type, the class itself with its own parameters, a variable, or a name that may mean several things.
    lone = F.concat(F.lit('{"h":"'), here, F.lit("|"), F.col("root.s"))
    self_ = F.concat(lone, F.lit('","a":['), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: F.concat(F.lit('{"p":'), n.cast("string"), F.lit("}"))), ","), F.lit("]}"))
    states = found.where("root.t is not null").select("id", F.col("root.t").alias("term"), "steps")
    states = states.unionByName(found.where("root.s is not null").select("id", self_.alias("term"), "steps"))
    waits = found.where("root.v is not null").select("id", here.alias("key"), F.lit("").alias("owner"), F.col("root.v").alias("name"), F.lit("value").alias("slot"), none.alias("args"), none.alias("given"), "steps")
    named = found.where("root.n is not null").withColumn("local", F.col("root.n")).join(bound, ["path", "local"], "left")
    named = named.select("id", "path", "local", F.coalesce("def_key", here).alias("key"), F.coalesce("def_name", "local").alias("name"), "steps")
    # A member of a namespace is what its module exports under that name; its step is taken as the root's own.
    spaces = facts(rows, "import", a="local", b="original", c="module").where("module is not null and original = '*'").select("path", "local", "module")
    exported = defined.select(F.col("key").alias("module"), F.col("exported").alias("member"), "def_key", "def_name")
    first = F.get("steps", F.lit(0))
    within = named.where("size(steps) > 0").withColumn("member", first["m"]).join(spaces, ["path", "local"]).join(exported, ["module", "member"])
    called = F.array(F.struct(F.lit("").alias("m"), first["c"].alias("c"), first["t"].alias("t")))
    within = within.select("id", F.col("def_key").alias("key"), F.col("def_name").alias("name"), F.when(first["c"], F.concat(called, rest)).otherwise(rest).alias("steps"))
    named = named.select("id", "key", "name", "steps").unionByName(within)
    call = (F.size("steps") > 0) & (first["m"] == "")
    waits = waits.unionByName(named.where(call).select("id", "key", F.lit("").alias("owner"), "name", F.lit("returns").alias("slot"), none.alias("args"), first["t"].alias("given"), rest.alias("steps")))
    waits = waits.unionByName(named.where(~call).select("id", "key", F.lit("").alias("owner"), "name", F.lit("value").alias("slot"), none.alias("args"), none.alias("given"), "steps"))
    classes = named.where(~call).join(own.select("key", F.col("owner").alias("name")).distinct(), ["key", "name"], "left_semi")
    states = states.unionByName(classes.select("id", F.concat(F.lit('{"h":"'), "key", F.lit("|"), "name", F.lit('","a":[]}')).alias("term"), "steps"))

    def answers(waiting: DataFrame, slots: DataFrame) -> DataFrame:
        met = waiting.join(slots, list(_SLOT))
        return met.select("id", filled(filled(F.col("term"), "p", F.col("args")), "f", F.col("given")).alias("term"), "steps").distinct()

    known_all = new_known = keep(known, "types_slots_0")
    waits_all = new_waits = keep(waits.distinct(), "types_waits_0")
    seen = new_states = keep(states.distinct(), "types_states_0")
    # What is new in a round is written once; all that is known is the union of these.
    for step in count(1):
        if new_states.isEmpty():
            break
        # What the new states ask for, and what those without steps tell.
        at = _at(new_states)
        ready = at.where("size(steps) = 0").select("id", "term").join(goals.where("slot != 'call'"), "id")
        told = ready.select(here.alias("key"), "owner", F.col("target").alias("name"), "slot", "term").distinct()
        going = at.where("size(steps) > 0").withColumn("name", first["m"])
        asked = going.where("owner != '[]'").select("id", "key", "owner", "name", F.when(first["c"], "returns").otherwise("value").alias("slot"), "args", first["t"].alias("given"), rest.alias("steps"))
        elements = going.where("owner = '[]' and name = '[]'").select("id", F.get("args", F.lit(0)).alias("term"), rest.alias("steps"))
        lifted = going.join(own, ["key", "owner", "name"], "left_anti").join(supers, ["key", "owner"]).select("id", filled(F.col("base"), "p", F.col("args")).alias("term"), "steps")
        fresh_waits = keep(asked.distinct().join(waits_all, ["id", *_SLOT, "args", "given", "steps"], "left_anti"), f"types_waits_{step}")
        fresh_known = keep(told.join(known_all, [*_SLOT, "term"], "left_anti"), f"types_slots_{step}")
        # New questions meet all slots, old ones only the new slots.
        new_waits = new_waits.unionByName(fresh_waits) if step == 1 else fresh_waits
        got = answers(new_waits, known_all.unionByName(fresh_known))
        if step > 1:
            got = got.unionByName(answers(waits_all, fresh_known))
        waits_all, known_all = waits_all.unionByName(fresh_waits), known_all.unionByName(fresh_known)
        made = got.unionByName(elements).unionByName(lifted).where("term is not null").distinct()
        new_states = keep(made.join(seen, ["id", "term", "steps"], "left_anti"), f"types_states_{step}")
        seen = seen.unionByName(new_states)
    # A call means the last member of its expression, in the class that declares it.
    last = _at(seen).where("size(steps) = 1").withColumn("name", first["m"]).where(first["c"])
    calls = goals.where("slot = 'call'").select("id", "path", F.col("target").alias("source"))
    hits = last.join(calls, "id").join(methods, ["key", "owner", "name"], "left_semi")
    return keep(hits.select("path", "source", F.col("name").alias("target_name"), F.col("owner").alias("target_parent")).distinct(), "types_calls")
