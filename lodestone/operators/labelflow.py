"""Sets of labels that flow along a graph to a fixed point.

A node's set is the union of its own labels and the sets of all nodes with an
edge to it.  Sets are rows (node, word, bits) of 64 labels each, united by
``bit_or``; a round sends only bits that are new (semi-naive evaluation).
Strongly connected components are one node, chains of nodes with one edge out
are passed by doubling, so rounds are left only for places that branch.

The join of the taint lattice's values is a union in this form too: a label
that is still dangerous for a kind of sink is a bit in that kind's lane, an
edge that sanitizes for a kind has none in its lane, and what two paths clear
both stays cleared (operators/lattice.py has single values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.graph import Jumps, _pairs, _single, components
from lodestone.operators.lineage import cut, shuffled
from lodestone.operators.rangescan import running

WORD = 64


def numbered(labels: DataFrame) -> DataFrame:
    """(label, word, bit): the distinct labels numbered in order, by a scan in ranges."""
    ordered = labels.select(F.col(f"`{labels.columns[0]}`").alias("label")).filter("label IS NOT NULL").distinct().withColumn("all", F.lit(0))
    at = F.col("n") - 1
    return running(ordered, ["all"], ["label"], {"n": ("sum", F.lit(1).cast("long"))}).select("label", F.floor(at / WORD).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast((n - 1) % {WORD} as int))").alias("bit"))


def _united(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "word").agg(F.bit_or("bits").alias("bits"))


def _new(delta: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return delta
    both = delta.join(known.withColumnRenamed("bits", "had"), ["node", "word"], "left")
    return both.select("node", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("had", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0")


def label_sets(seeds: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets (node, word, bits) of every node that any label reaches, and the labels' numbers (label, word, bit).

    seeds: (node, label); edges: (a, b), from a to b.  Rows with a null are
    left out, repeated ones count once; a seed need not have an edge.
    """
    links = cut(_pairs(edges, "a", "b"))
    node, label = seeds.columns[:2]
    seeds = cut(seeds.select(F.col(f"`{node}`").alias("node"), F.col(f"`{label}`").alias("label")).filter("node IS NOT NULL AND label IS NOT NULL").distinct())
    names = cut(numbered(seeds.select("label")))
    of = cut(components(links))
    named = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    between = cut(links.join(named("a"), "a").join(named("b"), "b").filter("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
    jumps = Jumps(_single(between))
    branching = cut(between.join(jumps.tables[0].select(F.col("node").alias("a")), "a", "left_anti")) if jumps.tables else between
    placed = seeds.join(of, "node", "left").join(names, "label")
    delta = cut(_united(placed.select(F.coalesce("component", "node").alias("node"), "word", F.col("bit").alias("bits"))))
    known = None
    while True:
        for table in jumps.tables:
            delta = cut(_united(delta.unionByName(delta.join(table, "node").select(F.col("up").alias("node"), "word", "bits"))))
        fresh = cut(_new(delta, known))
        if fresh.isEmpty():
            break
        known = fresh if known is None else cut(_united(known.unionByName(fresh)))
        delta = cut(_united(fresh.join(branching, F.col("node") == F.col("a")).select(F.col("b").alias("node"), "word", "bits")))
    if known is None:
        known = delta
    members = of.select(F.col("node").alias("member"), F.col("component").alias("node"))
    out = known.join(members, "node", "left").select(F.coalesce("member", "node").alias("node"), "word", "bits")
    return shuffled(out), names


def listed(sets: DataFrame, names: DataFrame) -> DataFrame:
    """(node, label): a row for each label of a node's set."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit(F.col("bits"), i) == 1)
    numbers = names.select("label", "word", F.round(F.log2(F.abs(F.col("bit").cast("double")))).cast("int").alias("place"))
    return sets.select("node", "word", F.explode(places).alias("place")).join(numbers, ["word", "place"]).select("node", "label")


def counted(sets: DataFrame) -> DataFrame:
    """(node, n): how many labels each node's set has, without a row for each."""
    return sets.groupBy("node").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"))


def dangerous(seeds: DataFrame, edges: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sets (node, kind, word, bits) of labels that reach a node without being sanitized for that kind of sink, and the labels' numbers.

    edges: (a, b, clears), clears the kinds that a value passing the edge is
    sanitized for (null for none).
    """
    kind = F.explode(F.array(*map(F.lit, kinds))).alias("kind")
    node, label = seeds.columns[:2]
    lanes = seeds.select(F.col(f"`{node}`").alias("n"), F.col(f"`{label}`").alias("label"), kind).filter("n IS NOT NULL")
    passed = edges.filter("a IS NOT NULL AND b IS NOT NULL").select("a", "b", "clears", kind).filter(~F.coalesce(F.array_contains("clears", F.col("kind")), F.lit(False)))
    at = lambda c: F.struct(F.col("kind"), F.col(c).alias("node"))
    sets, names = label_sets(lanes.select(at("n"), "label"), passed.select(at("a"), at("b")))
    return sets.select("node.node", "node.kind", "word", "bits"), names
