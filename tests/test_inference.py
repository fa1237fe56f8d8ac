"""Types by inference over a table of sources, and aliases in long chains."""

import time

import pytest

from codeatlas.operators.inference import filled, inferred_refs
from codeatlas.sources.parser import parse_files, parse_source
from pyspark.sql import functions as F

FIRST = """
export class Base<T> { up(): T { return null as any; } hook() {} }
export class Box<T> { private held: T; get(): T { return this.held; } wrap() { return new Box<Box<T>>(); } pair<U>(u: U): Pair<T, U> { return 0 as any; } }
export interface Pair<A, B> { left: A; right(): B; }
export class Runner extends Base<Walker> { run() { return this; } get next(): Runner { return this; } stop() {} }
export class Walker { run() {} }
export function make() { return new Runner(); }
export const later = async <U>(x: U): Promise<Box<U>> => { return 1 as any; };
export const engine = new Runner();
export class Factory { static create(): Runner { return new Runner(); } }
export class Own { run() {} stop() {} }
"""
SECOND = """
import { make as build, Box, Runner, later, engine, Factory, Own } from './a';
import * as lib from './a';
function called() { build().run(); }
function assigned() { const x = build(); x.run(); }
function argument(b: Box<Runner>) { b.get().stop(); }
async function awaited() { (await later<Runner>(1)).get().run(); }
function elements(list: Runner[]) { for (const r of list) { r.next.stop(); } list[0].run(); }
function values() { engine.stop(); Factory.create().run(); }
function long() { build().run().run().stop(); }
function inherited() { build().up().run(); build().hook(); }
function spaced() { lib.make().stop(); }
function nested(b: Box<Runner>) { b.wrap().get().get().stop(); }
function pairs(b: Box<Runner>) { b.pair<Own>(1).left.stop(); b.pair<Own>(1).right().run(); }
function rounds() { const x = other(); x.stop(); }
const other = () => pass();
function pass() { return loop(); }
function loop() { if (1) { return pass(); } return new Own(); }
function shadowed(x: Own) { { const x = build(); x.stop(); } x.run(); }
function cast(x: any) { (x as Own).stop(); }
function unknown(x: any) { x.run(); [1].map(y => y.run()); }
"""
WANTED = {
    "called": {("run", "Runner")},
    "assigned": {("run", "Runner")},
    "argument": {("get", "Box"), ("stop", "Runner")},
    "awaited": {("get", "Box"), ("run", "Runner")},
    "elements": {("stop", "Runner"), ("run", "Runner")},
    "values": {("stop", "Runner"), ("create", "Factory"), ("run", "Runner")},
    "long": {("run", "Runner"), ("stop", "Runner")},
    "inherited": {("up", "Base"), ("run", "Walker"), ("hook", "Base")},
    "spaced": {("stop", "Runner")},
    "nested": {("wrap", "Box"), ("get", "Box"), ("stop", "Runner")},
    "pairs": {("pair", "Box"), ("stop", "Runner"), ("run", "Own")},
    "rounds": {("stop", "Own")},
    "shadowed": {("stop", "Runner"), ("run", "Own")},
    "cast": {("stop", "Own")},
}


def test_inferred_calls(spark):
    texts = spark.createDataFrame([("src/a.ts", FIRST), ("src/b.ts", SECOND), ("src/c.ts", "function (((<<")], "path string, text string")
    parsed = parse_files(texts).cache()
    found = {}
    for r in inferred_refs(parsed).collect():
        assert r.path == "src/b.ts"
        found.setdefault(r.source.removeprefix("function:"), set()).add((r.target_name, r.target_parent))
    assert found == WANTED


def test_type_arguments_stay_apart(spark):
    row = spark.range(1).select(filled(F.lit('{"h":"m|P","a":[{"p":1},{"p":0}]}'), "p", F.array(F.lit('{"p":1}'), F.lit('{"h":"m|X","a":[]}'))).alias("t")).first()
    assert row.t == '{"h":"m|P","a":[{"h":"m|X","a":[]},{"p":1}]}'


def test_types_that_grow_without_end(spark):
    text = "export class N<T> { next(): N<N<T>> { return this as any; } }\nfunction f(n: N<N<number>>) { return f2(n).next(); }\nfunction f2(n) { return f3(); }\nfunction f3() { return new N<N<string>>().next(); }"
    found = inferred_refs(parse_files(spark.createDataFrame([("a.ts", text)], "path string, text string")).cache()).collect()
    assert {(r.source, r.target_name, r.target_parent) for r in found} == {("function:f", "next", "N"), ("function:f3", "next", "N")}


@pytest.mark.parametrize("cycle", [False, True])
def test_long_chains_of_aliases(cycle):
    n = 10_000
    text = "".join(f"const a{i} = a{i + 1};\n" for i in range(n)) + f"const a{n} = {'a0' if cycle else 'end'};\nfunction f() {{ a0(); }}\n"
    start = time.process_time()
    refs = parse_source("a.ts", text).refs
    assert time.process_time() - start < 3
    assert [r[1] for r in refs] == [f"a{i}" for i in range(n + 1)] + ([] if cycle else ["end"])


def test_hostile_nesting():
    for text in ("(" * 5000 + "x" + ")" * 5000, "function f() { " + "(" * 3000 + "a.b()" + ")" * 3000 + " }", "let x: " + "A<" * 3000, "const f = " + "(a) => " * 1000 + "1"):
        start = time.process_time()
        parse_source("a.ts", text)
        assert time.process_time() - start < 5
