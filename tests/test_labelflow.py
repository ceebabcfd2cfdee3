import random

import pytest

from lodestone.operators import taint
from lodestone.operators.labelflow import counted, dangerous, label_sets, listed


def closure(seeds, edges):
    out = {}
    for n, label in seeds:
        todo, seen = [n], {n}
        while todo:
            x = todo.pop()
            out.setdefault(x, set()).add(label)
            for a, b in edges:
                if a == x and b not in seen:
                    seen.add(b)
                    todo.append(b)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_sets_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:02}" for i in range(30)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range((30, 45, 20)[seed])]
    seeds = [(rng.choice(nodes), f"l{i:03}") for i in range(150)] + [("outside", "l000"), ("n00", "l001"), ("n00", "l001")]
    sets, names = label_sets(spark.createDataFrame([*seeds, (None, "l"), ("n01", None)], "n string, l string"), spark.createDataFrame([*edges, (None, "n00")], "a string, b string"))
    wanted = closure(seeds, edges)
    got = {}
    for r in listed(sets, names).collect():
        assert r.label not in got.setdefault(r.node, set())
        got[r.node].add(r.label)
    assert got == wanted
    assert {r.node: r.n for r in counted(sets).collect()} == {n: len(s) for n, s in wanted.items()}


def test_a_long_chain_with_a_loop_takes_few_rounds(spark):
    n = 20_000
    from pyspark.sql import functions as F

    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(n, n // 2)], "a long, b long"))
    sets, _ = label_sets(spark.createDataFrame([(0, "s"), (n // 2 + 7, "t")], "n long, l string"), chain)
    got = counted(sets)
    assert (got.filter("n = 1").count(), got.filter("n = 2").count()) == (n // 2, n // 2 + 1)


def test_lanes_that_edges_clear(spark):
    edges = [("a", "b", ["sql"]), ("a", "c", None), ("c", "d", ["xss", "sql"]), ("b", "d", []), ("d", "a", ["xss"])]
    seeds = [("a", "s1"), ("c", "s2")]
    sets, names = dangerous(spark.createDataFrame(seeds, "node string, label string"), spark.createDataFrame(edges, "a string, b string, clears array<string>"), ["sql", "xss"])
    got = {}
    for kind in ("sql", "xss"):
        for r in listed(sets.filter(f"kind = '{kind}'").drop("kind"), names).collect():
            got.setdefault((r.node, kind), set()).add(r.label)
    wanted = {}
    for kind in ("sql", "xss"):
        for node, labels in closure(seeds, [(a, b) for a, b, clears in edges if kind not in (clears or [])]).items():
            wanted[node, kind] = labels
    assert got == wanted


def test_empty(spark):
    none = spark.createDataFrame([], "a string, b string")
    sets, names = label_sets(none, none)
    assert sets.collect() == [] and names.collect() == []
    sets, names = label_sets(spark.createDataFrame([("x", "l")], "n string, l string"), none)
    assert [tuple(r) for r in listed(sets, names).collect()] == [("x", "l")]


def test_every_source_of_a_value_is_kept(spark):
    seeds = spark.createDataFrame([("m1", "x", "f:1"), ("m2", "y", "f:2"), ("m9", "z", "f:9")], "uid string, var string, source_loc string")
    sites = [("m1", "m3", ["x"]), ("m2", "m3", ["y + 1"]), ("m3", "m4", ["0", "param_0"]), ("m4", "m3", ["param_1"]), ("m9", "m4", ["q"])]
    sets, names = taint.source_sets(seeds, spark.createDataFrame(sites, "caller_uid string, callee_uid string, args array<string>"))
    from pyspark.sql import functions as F

    got = {}
    for r in listed(sets.select(F.struct("uid", "var").alias("node"), "word", "bits"), names).collect():
        got.setdefault((r.node.uid, r.node["var"]), set()).add(r.label)
    assert got == {("m1", "x"): {"f:1"}, ("m2", "y"): {"f:2"}, ("m9", "z"): {"f:9"}, ("m3", "param_0"): {"f:1", "f:2"}, ("m4", "param_1"): {"f:1", "f:2"}}
