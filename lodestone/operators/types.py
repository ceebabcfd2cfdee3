"""Types of Java sources: who extends and implements whom, methods by class, and what a call or an expression may mean."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.javacode import Java
from lodestone.functions.regex import java
from lodestone.operators.graph import Jumps, ancestors
from lodestone.operators.lineage import cut, shuffled
from lodestone.operators.rangescan import running

_CLASSES = "class_name string, extends string, implements array<string>, file_path string, line int"
_SIGNATURES = "class_name string, method_name string, params array<string>, return_type string, file_path string, line int, is_static boolean, is_abstract boolean"
#: Targets that a call by name keeps.
MOST_TARGETS = 5
#: Rows that a scan of intervals takes at a time, at least.
SCANNED = 100_000
#: Stands for no class's number.
NONE = np.iinfo(np.int64).max


def _columns(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def parameter_type(text: str) -> str | None:
    """The type of a declared parameter; a lone word is an Object's name."""
    words = re.sub(r"@\w+\s*(\([^)]*\))?\s*", "", text).strip().replace("...", "").split()
    return words[-2] if len(words) > 1 else "Object" if words else None


def classes(files: DataFrame) -> DataFrame:
    """One row per Java class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False, name=None):
                source = Java(content or "")
                rows.extend((t.name, t.extends, t.implements, path, source.line_of(t.start)) for t in source.classes())
            yield pd.DataFrame(rows, columns=_columns(_CLASSES))

    return files.filter(F.col("ext") == ".java").select("path", "content").mapInPandas(run, _CLASSES)


def signatures(files: DataFrame) -> DataFrame:
    """One row per method of a Java class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False, name=None):
                source = Java(content or "")
                for t in source.classes():
                    for m in t.methods:
                        rows.append((t.name, m.name, [p for p in map(parameter_type, m.parameters) if p], m.return_type, path, source.line_of(m.start), m.static, m.abstract))
            yield pd.DataFrame(rows, columns=_columns(_SIGNATURES))

    return files.filter(F.col("ext") == ".java").select("path", "content").mapInPandas(run, _SIGNATURES)


def _parents(found: DataFrame) -> DataFrame:
    return found.filter("extends IS NOT NULL").groupBy(F.col("class_name").alias("child")).agg(F.max("extends").alias("parent"))


def chains(found: DataFrame) -> DataFrame:
    """(class_name, ancestor, depth): each class with itself (0), its superclasses to the root, and Object."""
    all_ = ancestors(_parents(found), found.select("class_name")).select(F.col("start").alias("class_name"), F.col("node").alias("ancestor"), F.col("depth").cast("int").alias("depth"))
    last = all_.groupBy("class_name").agg(F.max("depth").alias("d"), F.bool_or(F.col("ancestor") == "Object").alias("has")).filter("NOT has")
    return all_.unionByName(last.select("class_name", F.lit("Object").alias("ancestor"), (F.col("d") + 1).alias("depth")))


def interfaces(found: DataFrame) -> DataFrame:
    """(class_name, interface): those of a class and of all its superclasses."""
    own = found.select(F.col("class_name").alias("ancestor"), F.explode("implements").alias("interface")).distinct()
    return chains(found).join(shuffled(own), "ancestor").select("class_name", "interface").distinct()


def subtypes(found: DataFrame) -> DataFrame:
    """(subtype, supertype): every class with itself, its superclasses and its interfaces."""
    up = chains(found).select(F.col("class_name").alias("subtype"), F.col("ancestor").alias("supertype"))
    return up.unionByName(interfaces(found).select(F.col("class_name").alias("subtype"), F.col("interface").alias("supertype"))).distinct()


def labels(found: DataFrame) -> DataFrame:
    """(class_name, pre, post, known, number): numbers of a walk through the class tree below Object, so that a class is C or below it exactly if its pre lies from pre to post of C.

    Numbers come from sums by doubling: the sizes of subtrees, then for each
    node those of the siblings before it, then these along the way up.  Classes
    that extend each other in a circle share one place.  known: whether the
    class itself is there, and not only named as a parent.  number: grows with
    the class's name.
    """
    up = cut(_parents(found).filter("child <> 'Object'"))
    named = found.select("class_name", F.lit(True).alias("known")).unionByName(up.select(F.col("parent").alias("class_name"), F.lit(False).alias("known"))).unionByName(_root(found, "class_name string, known boolean", ("Object", False)))
    at = cut(named.groupBy("class_name").agg(F.max("known").alias("known")).withColumn("node", F.col("class_name")))
    tree = _rooted(at, up.select(F.col("child").alias("node"), F.col("parent").alias("up")))
    jumps = Jumps(tree)
    if jumps.looped:
        loops = cut(jumps.loops().withColumnRenamed("node", "class_name"))
        at = cut(at.drop("node").join(loops, "class_name", "left").select("class_name", "known", F.coalesce("component", "class_name").alias("node")))
        outside = up.join(loops.select(F.col("class_name").alias("child")), "child", "left_anti")
        tree = _rooted(at, outside.join(at.select(F.col("class_name").alias("parent"), F.col("node").alias("up")), "parent").select(F.col("child").alias("node"), "up"))
        jumps = Jumps(tree)
    size = jumps.summed(at.select("node").distinct().withColumn("size", F.lit(1).cast("long")), {"size": "sum"}, upward=False)
    before = running(tree.join(size, "node"), ["up"], ["node"], {"with": ("sum", F.col("size"))}).select("node", (F.col("with") - F.col("size") + 1).alias("pre"))
    pre = jumps.summed(before.unionByName(_root(found, "node string, pre long", ("Object", 0))), {"pre": "sum"}, upward=True)
    numbers = pre.join(size, "node").select("node", "pre", (F.col("pre") + F.col("size") - 1).alias("post"))
    placed = at.join(numbers, "node").select("class_name", "pre", "post", "known")
    ranges = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(placed.repartitionByRange(ranges, "class_name").sortWithinPartitions("class_name").withColumn("number", F.monotonically_increasing_id()))


def _rooted(at: DataFrame, tree: DataFrame) -> DataFrame:
    """The tree's (node, up) with Object above all that have nothing above them."""
    roots = at.select("node").filter("node <> 'Object'").distinct().join(tree.select("node"), "node", "left_anti")
    return cut(tree.unionByName(roots.select("node", F.lit("Object").alias("up"))))


def _root(like: DataFrame, schema: str, row: tuple) -> DataFrame:
    names, kinds = zip(*[c.split(" ") for c in schema.split(", ")], strict=True)
    return like.sparkSession.range(1).select(*[F.lit(v).cast(k).alias(c) for c, k, v in zip(names, kinds, row, strict=True)])


def _held(group: np.ndarray, at: np.ndarray, opens: np.ndarray, post: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """(sums, least numbers) of the intervals that hold each question, 0 where none does, and the rows of intervals that are open after the last row.

    Rows are sorted by group (from 0) and place; intervals of a group lie in one
    another or apart.  What holds a place is then all that opened before it less
    all that ended, and an interval lies in the last one before it that has one
    less around it.
    """
    high = max(int(at.max()), int(post.max())) + 1
    place, o = group * high + at, np.flatnonzero(opens)
    asks, k = np.flatnonzero(~opens), len(o)
    ends = place[o] - at[o] + post[o]
    by_end = np.argsort(ends, kind="stable")
    gone, before = np.searchsorted(ends[by_end], place), np.cumsum(opens) - opens
    around = before - gone
    opened, ended = np.concatenate(([0], np.cumsum(n[o]))), np.concatenate(([0], np.cumsum(n[o][by_end])))
    sums, least = opened[before[asks]] - ended[gone[asks]], np.zeros(len(asks), np.int64)
    inside = around[asks] > 0
    if inside.any():
        depth = around[o]
        order = np.argsort(depth, kind="stable")
        keys = depth[order] * (k + 1) + order
        holder = lambda depth, index: order[np.searchsorted(keys, (depth - 1) * (k + 1) + index) - 1]
        up, value, nested = np.arange(k), number[o], np.flatnonzero(depth)
        up[nested] = holder(depth[nested], nested)
        while True:  # twice as far up each time
            value, further = np.minimum(value, value[up]), up[up]
            if (further == up).all():
                break
            up = further
        least[inside] = value[holder(around[asks[inside]], before[asks[inside]])]
    return sums, least, o[ends >= place[-1]]


def _scanned(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(questions, sums, least numbers) of rows sorted by key and at, many rows at a time; at last the intervals that are open at the end.

    Intervals that are open are carried from rows to rows; they are as many as
    declarations of one name are nested.
    """
    held: list[pa.RecordBatch] = []
    carried = None

    def scan() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        nonlocal carried
        rows = pa.concat_batches(held if carried is None else [carried, *held])
        held.clear()
        keys = rows.column(key)
        group = np.zeros(len(keys), np.int64)
        group[1:] = np.cumsum(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False))
        at, kind, post, n, number = (rows.column(c).to_numpy() for c in ("at", "kind", "post", "n", "number"))
        sums, least, open_ = _held(group, at, kind == 0, post, n, number)
        carried = rows.take(pa.array(open_))
        return rows.take(pa.array(np.flatnonzero(kind))), sums, least

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= max(SCANNED, 2 * (carried.num_rows if carried else 0)):
                yield scan()
    if held:
        yield scan()
    if carried is not None:
        yield carried, None, None


_SCAN = "range int, kind int, method_name string, at long, post long, n long, number long, type string"


def _within_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a range of rows (_SCAN without range) knows for itself: kind 0 are intervals open at its end, 1 questions answered, 2 questions of its first name, that intervals from before may hold too, and 3 its first row."""
    range_ = TaskContext.get().partitionId()
    first = None

    def out(rows: pa.RecordBatch, kind: np.ndarray | int, n: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        own = {"range": np.full(rows.num_rows, range_, np.int32), "kind": np.broadcast_to(np.int32(kind), rows.num_rows), "n": n, "number": number}
        return pa.RecordBatch.from_arrays([pa.array(own[c]) if c in own else rows.column(c) for c in _columns(_SCAN)], _columns(_SCAN))

    def watched() -> Iterator[pa.RecordBatch]:
        nonlocal first
        for batch in batches:
            if first is None and batch.num_rows:
                first = batch.slice(0, 1)
            yield batch

    for rows, sums, least in _scanned(watched(), "method_name"):
        if sums is None:
            yield out(rows, 0, rows.column("n").to_numpy(), rows.column("number").to_numpy())
            yield out(first, 3, first.column("n").to_numpy(), first.column("number").to_numpy())
        elif rows.num_rows:
            of_first = pc.equal(rows.column("method_name"), first.column("method_name")[0]).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(of_first | (sums > 0))
            yield out(rows.take(pa.array(at)), np.where(of_first[at], 2, 1), sums[at], np.where(sums[at] > 0, least[at], NONE))


def _over_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions (their sums and least numbers so far) with what the intervals from before their range add, where any interval holds them."""
    for rows, sums, least in _scanned(batches, "range"):
        if sums is not None and rows.num_rows:
            n = sums + rows.column("n").to_numpy()
            number = np.minimum(rows.column("number").to_numpy(), np.where(sums > 0, least, NONE))
            at = pa.array(np.flatnonzero(n > 0))
            yield pa.RecordBatch.from_arrays([rows.column("type").take(at), rows.column("method_name").take(at), pa.array(n).take(at), pa.array(number).take(at)], names=["type", "method_name", "n", "number"])


def _covering(asked: DataFrame, declared: DataFrame, tree: DataFrame) -> DataFrame:
    """(type, method_name, n, number) of methods in a class or above it, number the least of their classes'.

    asked: (type, method_name); declared: (method_name, pre, post, n, number).
    Per name, each declaring class is the interval from its pre to its post, and
    a type asks at its pre which intervals hold it.  Both are sorted once into
    ranges that are scanned side by side.  A range's first name may have begun
    in the ranges before: only its questions, few of all, go on to a second
    scan, with the intervals that those ranges leave open.
    """
    own = declared.select("method_name", F.col("pre").alias("at"), F.lit(0).alias("kind"), "post", "n", "number", F.lit(None).cast("string").alias("type"))
    asks = asked.join(tree.filter("known").select(F.col("class_name").alias("type"), F.col("pre").alias("at")), "type")
    none = F.lit(0).cast("long")
    line = own.unionByName(asks.select("method_name", "at", F.lit(1).alias("kind"), none.alias("post"), none.alias("n"), none.alias("number"), "type"))
    ranges = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scanned = cut(line.repartitionByRange(ranges, "method_name", "at", "kind", "type").sortWithinPartitions("method_name", "at", "kind").mapInArrow(_within_range, _SCAN))
    begins = scanned.filter("kind = 3").select(F.col("range").alias("to"), "method_name", F.col("at").alias("begin"))  # a row a range
    carried = scanned.filter("kind = 0").join(F.broadcast(begins), "method_name").filter("range < to AND post >= begin").withColumn("range", F.col("to"))
    rows = scanned.filter("kind = 2").unionByName(carried.select(*scanned.columns))
    later = rows.repartition(ranges, "range").sortWithinPartitions("range", "at", "kind").mapInArrow(_over_ranges, "type string, method_name string, n long, number long")
    return later.unionByName(scanned.filter("kind = 1").select("type", "method_name", "n", "number"))


def target_counts(calls: DataFrame, found: DataFrame, methods: DataFrame) -> DataFrame:
    """(call_id, n, first_class): how many methods a call may mean, and the least class that has one; only calls that have any.

    As targets(), but methods are summed up per (type, name) before calls join:
    no row per call and candidate, nor per type and superclass, is made.  A
    call's row has its type's sums; calls without a type have those of the name.
    """
    found = cut(found)
    asked = cut(calls.filter("receiver_type IS NOT NULL").select(F.col("receiver_type").alias("type"), "method_name").distinct())
    tree = labels(found)
    implementing = found.select(F.explode("implements").alias("type"), "class_name").distinct().join(asked.select("type").distinct(), "type", "left_semi")
    place = tree.filter("known").select(F.col("class_name").alias("type"), F.col("pre").alias("at"))
    implementing = implementing.join(tree.select("class_name", "pre", "post"), "class_name").join(place, "type", "left")
    besides = implementing.filter("at IS NULL OR at < pre OR at > post").groupBy("class_name").agg(F.collect_list("type").alias("besides"))  # those above are counted
    # one shuffle for both: methods of one class and name are in one place, and a class's names in many
    signatures = methods.select("class_name", "method_name", "file_path", "line").repartition("class_name", "method_name").distinct()
    declared = signatures.groupBy("class_name", "method_name").agg(F.count(F.lit(1)).alias("n"))
    declared = cut(declared.join(shuffled(tree.join(besides, "class_name", "left")), "class_name", "left").select("method_name", "n", "pre", "post", "number", "besides", F.when(F.col("pre").isNull(), F.col("class_name")).alias("unknown")))
    first = [F.sum("n").alias("n"), F.min("number").alias("number")]
    above = _covering(asked, declared.filter("pre IS NOT NULL").select("method_name", "pre", "post", "n", "number"), tree)
    below = declared.select(F.explode("besides").alias("type"), "method_name", "n", "number").groupBy("type", "method_name").agg(*first)
    name_of = tree.select("number", F.col("class_name").alias("first_class"))
    by_type = cut(above.unionByName(below).groupBy("type", "method_name").agg(*first).join(name_of, "number").drop("number"))  # tables of their own, so that a hot pair's calls can be split
    known = declared.filter("pre IS NOT NULL").groupBy("method_name").agg(*first).join(name_of, "number").drop("number")
    unknown = declared.filter("pre IS NULL").groupBy("method_name").agg(F.sum("n").alias("n"), F.min("unknown").alias("first_class"))
    by_name = cut(known.unionByName(unknown).groupBy("method_name").agg(F.sum("n").alias("n"), F.min("first_class").alias("first_class")))
    typed = calls.filter("receiver_type IS NOT NULL").select("call_id", "method_name", F.col("receiver_type").alias("type")).join(by_type, ["type", "method_name"])
    untyped = calls.filter("receiver_type IS NULL").select("call_id", "method_name").join(by_name, "method_name")
    return typed.select("call_id", "n", "first_class").unionByName(untyped.select("call_id", "n", "first_class"))


def targets(calls: DataFrame, found: DataFrame, methods: DataFrame) -> DataFrame:
    """(call_id, class_name, file_path, line): methods that a call may mean, a row each; target_counts() counts them without.

    calls: (call_id, method_name, receiver_type, n_args).  With a receiver's
    type: the methods of that name in it and its superclasses, and if it is an
    interface in all classes that implement it; without one: all of that name.
    Any number of arguments fits, as parameters may be optional or variable.
    Types and names that are asked for meet their methods once, then calls.
    """
    named = methods.select("method_name", "class_name", "file_path", "line").distinct()
    typed = calls.filter("receiver_type IS NOT NULL").select("call_id", "method_name", F.col("receiver_type").alias("type"))
    asked = cut(typed.select("type", "method_name").distinct())
    types_ = asked.select(F.col("type").alias("start")).distinct()
    own = ancestors(_parents(found), types_.join(found.select(F.col("class_name").alias("start")), "start", "left_semi")).select(F.col("start").alias("type"), F.col("node").alias("class_name"))
    object_ = own.select("type", F.lit("Object").alias("class_name"))
    implementing = found.select(F.explode("implements").alias("type"), "class_name").join(types_.withColumnRenamed("start", "type"), "type", "left_semi")
    scope = own.unionByName(object_).unionByName(implementing).distinct()
    wanted = named.join(asked.select("method_name").distinct(), "method_name", "left_semi")
    candidates = cut(scope.join(wanted, "class_name").join(asked, ["type", "method_name"], "left_semi"))
    by_type = typed.join(candidates, ["type", "method_name"]).select("call_id", "class_name", "file_path", "line")
    by_name = calls.filter("receiver_type IS NULL").select("call_id", "method_name").join(named, "method_name").select("call_id", "class_name", "file_path", "line")
    return by_type.unionByName(by_name).distinct()


def named_targets(calls: DataFrame, methods: DataFrame, most: int = MOST_TARGETS) -> DataFrame:
    """(call_id, file_path, class_name, line, place): the first methods of a call's name that take as many arguments or more, by file and line.

    Methods are ranked by name and number of parameters before calls join, so
    that a name which very many methods have costs a call at most ``most`` rows
    for each number of parameters.
    """
    sized = methods.select("method_name", F.size("params").alias("n_params"), "file_path", "class_name", "line")
    within = Window.partitionBy("method_name", "n_params").orderBy("file_path", "line", "class_name")
    first = sized.withColumn("k", F.row_number().over(within)).filter(F.col("k") <= most).drop("k")
    joined = calls.select("call_id", "method_name", "n_args").join(first, "method_name").filter("n_params >= n_args")
    ranked = joined.withColumn("place", F.row_number().over(Window.partitionBy("call_id").orderBy("file_path", "line", "class_name")))
    return ranked.filter(F.col("place") <= most).select("call_id", "file_path", "class_name", "line", "place")


def guessed(name: Column) -> Column:
    """The class that a variable's name suggests: its own with a capital."""
    return F.concat(F.upper(F.substring(name, 1, 1)), F.substr(name, F.lit(2)))


def guess_types(names: DataFrame, found: DataFrame) -> DataFrame:
    """(name, type): null where no such class is known."""
    known = found.select(F.col("class_name").alias("type")).distinct()
    return names.select("name", guessed(F.col("name")).alias("type")).join(known.withColumn("known", F.lit(True)), "type", "left").select("name", F.when(F.col("known"), F.col("type")).alias("type"))


def inferred(expression: Column) -> Column:
    """The type of a constructor call or a literal; null for anything else."""
    text = F.trim(expression)
    made = F.regexp_extract(text, "^" + java(r"new\s+(\w+)(?:<[^>]*>)?\s*\("), 1)
    return (
        F.when(made != "", made)
        .when(text.startswith('"') & text.endswith('"'), "String")
        .when(text.rlike(r"^-?\d+L?$"), F.when(text.endswith("L"), "long").otherwise("int"))
        .when(text.rlike(r"^-?\d+\.\d+[fF]?$"), F.when(F.lower(text).endswith("f"), "float").otherwise("double"))
        .when(text.isin("true", "false"), "boolean")
    )
