"""Walks over parents and over directed graphs in few rounds: pointer doubling, condensation, and walks over what is left.

Where every node has one parent at most, a table of jumps of length 2^k is the
table of length 2^(k-1) joined to itself, so a chain of d nodes takes log2 d
rounds and not d.  A general graph is first shortened: nodes with one edge out
are jumped over in the same way, and strongly connected components become one
node, so rounds are left only for places where a walk really branches.

Node names may be of any type that can be ordered.  Rows with a null end are no
edges, repeated ones count once, empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.lineage import cut, shuffled


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    first, second = df.columns[:2]
    return df.select(F.col(f"`{first}`").alias(a), F.col(f"`{second}`").alias(b)).filter(f"{a} IS NOT NULL AND {b} IS NOT NULL").distinct()


class Jumps:
    """Tables (node, up) of the jumps of 1, 2, 4, ... steps along parents, each node having one at most.

    They end when no node is so far from its root, or when a jump is longer
    than there are nodes: who still jumps then is on a loop or leads to one.
    """

    def __init__(self, parents: DataFrame) -> None:
        first = cut(_pairs(parents, "node", "up"))
        n, length = first.count(), 1
        self.tables = [first] if n else []
        self.looped = False
        while n:
            last = self.tables[-1]
            if length > n:
                self.looped = True
                break
            following = cut(last.join(last.select(F.col("node").alias("up"), F.col("up").alias("upper")), "up").select("node", F.col("upper").alias("up")))
            if following.isEmpty():
                break
            self.tables.append(following)
            length *= 2

    def above(self, starts: DataFrame) -> DataFrame:
        """(start, node, depth): each start with itself and all above it, by their least distance."""
        first = starts.columns[0]
        seen = starts.select(F.col(f"`{first}`").alias("start")).filter("start IS NOT NULL").distinct().select("start", F.col("start").alias("node"), F.lit(0).cast("long").alias("depth"))
        for k, table in enumerate(self.tables):
            more = seen.join(table, "node").select("start", F.col("up").alias("node"), (F.col("depth") + 2**k).alias("depth"))
            seen = seen.unionByName(more)
            seen = cut(seen.groupBy("start", "node").agg(F.min("depth").alias("depth")) if self.looped else seen)
        return seen

    def summed(self, values: DataFrame, sums: dict[str, str], upward: bool) -> DataFrame:
        """(node, *sums): each sum over the nodes below (a subtree) or, upward, over those above, the node itself included.

        values: (node, *columns) of all nodes; sums: column to sum, min or max.
        Sums of nodes that lead to a loop are not defined.
        """
        both = {"sum": lambda a, b: a + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
        names = list(sums)
        state = values.select("node", *names)
        for table in self.tables:
            moved = [F.col(c).alias(f"more_{c}") for c in names]
            if upward:
                more = table.join(state.select(F.col("node").alias("up"), *moved), "up").drop("up")
            else:
                joined = table.join(state.select("node", *moved), "node")
                more = joined.groupBy(F.col("up").alias("node")).agg(*[getattr(F, kind)(f"more_{c}").alias(f"more_{c}") for c, kind in sums.items()])
            state = cut(state.join(more, "node", "left").select("node", *[both[kind](F.col(c), F.col(f"more_{c}")).alias(c) for c, kind in sums.items()]))
        return state

    def ends(self) -> DataFrame:
        """(node, end): the last node above each node that has one; nodes that lead to a loop have none."""
        if not self.tables:
            return None
        state = self.tables[0].select("node", F.col("up").alias("end"))
        for table in reversed(self.tables):  # the longest jumps first, each where it does not pass the end
            state = cut(state.join(table.select(F.col("node").alias("end"), "up"), "end", "left").select("node", F.coalesce("up", "end").alias("end")))
        if self.looped:
            state = shuffled(state.join(self.tables[-1].select("node"), "node", "left_anti"))
        return state

    def loops(self) -> DataFrame | None:
        """(node, component): the nodes on loops, with the least of each loop; None without loops."""
        if not self.looped:
            return None
        on = self.tables[-1].select(F.col("up").alias("node")).distinct()
        least = on.select("node", F.col("node").alias("component"))
        for table in self.tables:
            more = table.join(least.select(F.col("node").alias("up"), F.col("component").alias("more")), "up")
            least = cut(least.join(more, "node").select("node", F.least("component", "more").alias("component")))
        return least


def ancestors(parents: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth) up a (child, parent) table; of a child's several parents the greatest name counts."""
    child, parent = parents.columns[:2]
    one = parents.filter(F.col(child).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.max(parent).alias("up"))
    return Jumps(one).above(starts)


def _single(edges: DataFrame) -> DataFrame:
    """(a, b): the edges of nodes that have one edge out."""
    return edges.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


def _shortened(edges: DataFrame) -> tuple[Jumps, DataFrame, DataFrame]:
    """Jumps along nodes with one edge out; (node, end) of them that come to a branch or an end; the edges between what is left."""
    jumps = Jumps(_single(edges))
    ends = jumps.ends()
    if ends is None:
        return jumps, edges.select(F.col("a").alias("node"), F.col("b").alias("end")).limit(0), edges
    singles = jumps.tables[0].select(F.col("node").alias("a"))
    left = edges.join(singles, "a", "left_anti")
    moved = left.join(ends.select(F.col("node").alias("b"), "end"), "b", "left").join(singles.select(F.col("a").alias("b"), F.lit(True).alias("single")), "b", "left")
    # an edge into a loop of single nodes leads nowhere else
    return jumps, ends, cut(moved.filter("end IS NOT NULL OR single IS NULL").select("a", F.coalesce("end", "b").alias("b")).distinct())


def _spread(labels: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(node, label): the greatest or least label that reaches each labelled node along the edges."""
    pick = getattr(F, kind)
    changed = state = cut(labels)
    while True:
        sent = edges.join(changed.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(pick("label").alias("sent"))
        better = F.col("sent") > F.col("label") if kind == "max" else F.col("sent") < F.col("label")
        changed = cut(state.join(sent, "node").filter(better).select("node", F.col("sent").alias("label")))
        if changed.isEmpty():
            return state
        state = cut(state.join(changed.withColumnRenamed("label", "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")))


def components(graph: DataFrame) -> DataFrame:
    """(node, component): every node with the least node of its strongly connected component.

    Loops of nodes with one edge out are found by doubling.  Among what is
    left, each node takes the greatest node that reaches it; those that a
    node's own colour leads back to it from are its component; that repeats
    without them.  Chains of single nodes then belong to a component from the
    first node on that it leads into.
    """
    edges = cut(_pairs(graph, "a", "b").filter("a <> b"))
    first, second = graph.columns[:2]
    every = cut(graph.select(F.explode(F.array(f"`{first}`", f"`{second}`")).alias("node")).filter("node IS NOT NULL").distinct())
    jumps, ends, left = _shortened(edges)
    found = [] if not jumps.looped else [jumps.loops().select("node", F.col("component"))]
    branching = left
    rest = cut(left.filter("a <> b"))
    alone = branching.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))  # comes back to itself over single nodes
    roots = []
    while not rest.isEmpty():
        # what nothing leads into or out of is in no component
        inner = rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        inner = cut(inner.join(inner.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if inner.count() < rest.count():
            rest = inner
            continue
        nodes = rest.select(F.col("a").alias("node")).distinct()
        colours = _spread(nodes.select("node", F.col("node").alias("label")), rest, "max")
        # back along edges of one colour from the node that gave it
        own = lambda end: colours.select(F.col("node").alias(end), F.col("label").alias(f"c_{end}"))
        same = cut(rest.join(own("a"), "a").join(own("b"), "b").filter("c_a = c_b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("c_a").alias("colour")))
        reached = frontier = cut(colours.filter("node = label"))
        while True:
            step = same.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node"), F.col("colour").alias("label")).distinct()
            frontier = cut(step.join(reached.select("node"), "node", "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut(reached.unionByName(frontier))
        roots.append(reached)
        gone = reached.select("node")
        rest = cut(rest.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    groups = alone.select("node", F.col("component").alias("label"))
    for r in roots:
        groups = groups.unionByName(r)
    # a node may be there alone and in a larger component: its label is the one that leads to most
    groups = cut(groups.groupBy("node").agg(F.max("label").alias("label")))
    # single nodes that lie on a way from a component back into it
    heads = edges.join(groups.select(F.col("node").alias("a"), "label"), "a").join(ends.select(F.col("node").alias("b"), "end"), "b")
    heads = heads.join(groups.select(F.col("node").alias("end"), F.col("label").alias("back")), "end").filter("label = back").select(F.col("b").alias("node"), "label").distinct()
    for table in jumps.tables:
        heads = cut(heads.unionByName(heads.join(table, "node").select(F.col("up").alias("node"), "label")).distinct())
    singles = jumps.tables[0].select("node") if jumps.tables else every.limit(0)
    grouped = groups.unionByName(heads.join(singles, "node", "left_semi"))
    least = shuffled(grouped.groupBy("label").agg(F.min("node").alias("component")))
    grouped = grouped.join(least, "label").select("node", "component")
    for f in found:
        grouped = grouped.unionByName(f)
    grouped = cut(grouped.distinct())
    return shuffled(every.join(grouped, "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def reachable(graph: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node): every node that a start reaches, itself included.

    The graph is condensed and shortened; what is walked round by round are
    branching components only, once for all starts of a component; nodes
    jumped over and members of components are put back at the end.
    """
    edges = cut(_pairs(graph, "a", "b"))
    first = starts.columns[0]
    begin = starts.select(F.col(f"`{first}`").alias("start")).filter("start IS NOT NULL").distinct()
    of = cut(components(edges))
    named = lambda end: of.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    between = cut(edges.join(named("a"), "a").join(named("b"), "b").filter("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct())
    jumps, ends, left = _shortened(between)
    from_ = cut(begin.join(of.withColumnRenamed("node", "start"), "start"))
    asked = from_.select(F.col("component").alias("start")).distinct()
    # a start that is a single node goes to its end first
    seen = asked.join(ends.withColumnRenamed("node", "start"), "start", "left").select("start", F.coalesce("end", "start").alias("at"))
    seen = frontier = cut(seen)
    while True:
        step = frontier.join(left.select(F.col("a").alias("at"), "b"), "at").select("start", F.col("b").alias("at")).distinct()
        frontier = cut(step.join(seen, ["start", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    # single nodes on the way: from the start itself and from every edge out of what was reached
    heads = asked.select("start", F.col("start").alias("node")).unionByName(seen.join(between.select(F.col("a").alias("at"), F.col("b").alias("node")), "at").select("start", "node")).distinct()
    for table in jumps.tables:
        heads = cut(heads.unionByName(heads.join(table, "node").select("start", F.col("up").alias("node"))).distinct())
    all_ = heads.unionByName(seen.select("start", F.col("at").alias("node"))).distinct()
    members = all_.join(of.select(F.col("component").alias("node"), F.col("node").alias("member")), "node").select(F.col("start").alias("component"), "member")
    out = from_.join(members, "component").select("start", F.col("member").alias("node"))
    return out.unionByName(begin.join(of.select(F.col("node").alias("start")), "start", "left_anti").select("start", F.col("start").alias("node")))
