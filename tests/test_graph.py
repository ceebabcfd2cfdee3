import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.graph import Jumps, ancestors, components, reachable


def reach(edges, start):
    out, todo = {start}, [start]
    while todo:
        for b in edges.get(todo.pop(), ()):
            if b not in out:
                out.add(b)
                todo.append(b)
    return out


def brute(pairs):
    edges = {}
    for a, b in pairs:
        if a is not None and b is not None:
            edges.setdefault(a, set()).add(b)
    nodes = {x for p in pairs for x in p if x is not None}
    return {n: reach(edges, n) for n in nodes}


def shapes(seed):
    rng = random.Random(seed)
    if seed == 0:
        return [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x"), (None, "q"), ("q", None), ("a", "b"), ("y", "x"), ("e", "f"), ("f", "g"), ("g", "e"), ("f", "h")]
    if seed == 1:  # loops joined by chains, with chains back
        loop = lambda p, n: [(f"{p}{i}", f"{p}{(i + 1) % n}") for i in range(n)]
        return loop("a", 9) + loop("b", 7) + [("a3", "z0"), ("z0", "z1"), ("z1", "b2"), ("b4", "y0"), ("y0", "y1"), ("y1", "y2"), ("y2", "a8")] + loop("c", 5) + [("w", "c0"), ("v", "w"), ("v", "a0")]
    n = 24
    return [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range((20, 28, 40, 12)[seed % 4])]


@pytest.mark.parametrize("seed", range(3))
def test_components_and_walks_equal_brute_force(spark, seed):
    pairs = shapes(seed)
    wanted = brute(pairs)
    df = spark.createDataFrame(pairs, "f string, t string")
    assert {r.node: r.component for r in components(df).collect()} == {n: min(m for m in r if n in wanted[m]) for n, r in wanted.items()}
    starts = sorted(wanted)[::2] + ["nowhere"]
    got = {}
    for r in reachable(df, spark.createDataFrame([(s,) for s in [*starts, starts[0], None]], "s string")).collect():
        assert r.node not in got.setdefault(r.start, set())
        got[r.start].add(r.node)
    assert got == {s: wanted.get(s, {s}) for s in starts}


def test_parents_with_loops_and_several_roots(spark):
    parents = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "a"), ("e", "f"), ("g", "g"), ("h", "f"), ("i", "h"), ("h", None), ("e", "A")]
    got = {(r.start, r.node): r.depth for r in ancestors(spark.createDataFrame(parents, "c string, p string"), spark.createDataFrame([(x,) for x in "abcdeghi"], "s string")).collect()}
    assert got == {
        ("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("b", "b"): 0, ("b", "c"): 1, ("c", "c"): 0, ("c", "b"): 1, ("d", "d"): 0, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3,
        ("e", "e"): 0, ("e", "f"): 1, ("g", "g"): 0, ("h", "h"): 0, ("h", "f"): 1, ("i", "i"): 0, ("i", "h"): 1, ("i", "f"): 2,
    }


def test_sums_over_trees(spark):
    rng = random.Random(4)
    up = {i: rng.randrange(max(0, i - 3), i) for i in range(1, 60)}
    jumps = Jumps(spark.createDataFrame(list(up.items()), "n int, p int"))
    values = spark.createDataFrame([(i, i * i % 17, i * 7 % 31) for i in range(60)], "node int, x int, y int")
    above = lambda i: [i] if i not in up else [i, *above(up[i])]
    down = {r.node: (r.x, r.y) for r in jumps.summed(values, {"x": "sum", "y": "min"}, upward=False).collect()}
    over = {r.node: (r.x, r.y) for r in jumps.summed(values, {"x": "sum", "y": "max"}, upward=True).collect()}
    for i in range(60):
        below = [j for j in range(60) if i in above(j)]
        assert down[i] == (sum(j * j % 17 for j in below), min(j * 7 % 31 for j in below))
        assert over[i] == (sum(j * j % 17 for j in above(i)), max(j * 7 % 31 for j in above(i)))


def test_a_chain_of_100000_and_a_long_loop_take_few_rounds(spark):
    n = 100_000
    chain = spark.range(1, n).select("id", (F.col("id") - 1).alias("p"))
    jumps = Jumps(chain)
    assert len(jumps.tables) <= 20 and not jumps.looped
    far = jumps.above(spark.createDataFrame([(n - 1,)], "s long")).agg(F.count("*"), F.max("depth"), F.countDistinct("node")).first()
    assert tuple(far) == (n, n - 1, n)
    loop = chain.unionByName(spark.createDataFrame([(0, 40_000), (1_000_000, 90_000), (90_000, 2_000_000)], "id long, p long"))
    got = reachable(loop, spark.createDataFrame([(1_000_000,), (2_000_000,)], "s long"))
    assert {r.start: r["count"] for r in got.groupBy("start").count().collect()} == {1_000_000: 90_001 + 2, 2_000_000: 1}
    of = components(loop)
    assert of.filter("component = 0").count() == 40_001


def test_empty(spark):
    none = spark.createDataFrame([], "a string, b string")
    starts = spark.createDataFrame([("x",)], "s string")
    assert components(none).collect() == [] and [tuple(r) for r in reachable(none, starts).collect()] == [("x", "x")]
    assert [tuple(r) for r in ancestors(none, starts).collect()] == [("x", "x", 0)]
    assert graph.Jumps(none).tables == []


def test_joins_of_cut_tables_shuffle(spark):
    """A side that is broadcast passes through the driver: in the rounds of a walk only shuffles may meet."""
    from lodestone.operators import labelflow, types
    from lodestone.operators.lineage import cut

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    edges = cut(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a long, b long"))
    other = spark.createDataFrame([(1, 5)], "a long, c long")
    classes = spark.createDataFrame([("A", None, ["I"]), ("B", "A", [])], "class_name string, extends string, implements array<string>")
    sets, names = labelflow.label_sets(other.select("a", "c"), edges)
    for df in (edges.join(other, "a"), other.join(edges.filter("b > 1").select("a"), "a", "left_semi"), graph.components(edges), graph.reachable(edges, other.select("a")), types.interfaces(classes), labelflow.listed(sets, names)):
        assert "Join" in plan(df) and "BroadcastHashJoin" not in plan(df)
