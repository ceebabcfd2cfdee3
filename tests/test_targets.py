import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import types


def brute(classes, methods, calls):
    parent, interfaces = {}, {}
    for name, up, implemented in classes:
        if up is not None:
            parent[name] = max(parent.get(name, ""), up)
        for i in implemented:
            interfaces.setdefault(i, set()).add(name)
    known = {c[0] for c in classes}
    out = {}
    for call, name, receiver in calls:
        if receiver is None:
            scope = None
        else:
            scope, at = set(interfaces.get(receiver, ())), receiver if receiver in known else None
            if at:
                scope.add("Object")
            while at is not None and not (at in scope and at != receiver and at not in interfaces.get(receiver, ()) and at != "Object"):
                scope.add(at)
                nxt = parent.get(at)
                if nxt is None or nxt == receiver or at == "Object":
                    break
                at = nxt
        found = {m for m in methods if m[1] == name and (scope is None or m[0] in scope)}
        if found:
            out[call] = (len(found), min(m[0] for m in found))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_counts_equal_brute_force_and_the_rows(spark, seed):
    rng = random.Random(seed)
    classes = [(f"C{i:02}", f"C{rng.randrange(i):02}" if i and rng.random() < 0.8 else None, [f"I{k}" for k in range(3) if rng.random() < 0.2]) for i in range(25)]
    classes += [("A", "B", []), ("B", "A", ["I0"]), ("D", "A", []), ("E", "Gone", ["C03"]), ("C03", None, ["C03"])]
    methods = [(rng.choice([c[0] for c in classes] + ["Object", "Gone"]), f"m{rng.randrange(4)}", f"f{k}", k) for k in range(90)]
    methods += methods[:5]
    receivers = [c[0] for c in classes] + ["I0", "I1", "I2", "Gone", "Unknown", None]
    calls = [(k, f"m{rng.randrange(5)}", rng.choice(receivers)) for k in range(200)]
    found = spark.createDataFrame(classes, "class_name string, extends string, implements array<string>")
    declared = spark.createDataFrame(methods, "class_name string, method_name string, file_path string, line int")
    asked = spark.createDataFrame([(*c, 0) for c in calls], "call_id int, method_name string, receiver_type string, n_args int")
    got = {r.call_id: (r.n, r.first_class) for r in types.target_counts(asked, found, declared).collect()}
    rows = types.targets(asked, found, declared).groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("class_name").alias("c"))
    assert got == {r.call_id: (r.n, r.c) for r in rows.collect()}
    assert got == brute(classes, set(methods), calls)


def test_labels_are_ranges_of_the_tree(spark):
    classes = [("R", None), ("a", "R"), ("b", "R"), ("c", "a"), ("d", "a"), ("e", "c"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")]
    found = spark.createDataFrame([(n, u, []) for n, u in classes], "class_name string, extends string, implements array<string>")
    at = {r.class_name: (r.pre, r.post) for r in types.labels(found).collect()}
    below = lambda a, b: at[b][0] <= at[a][0] <= at[b][1]
    up = dict(classes)
    for a in up:
        above, node = {a, "Object"}, up[a]
        while node is not None and node not in above:
            above.add(node)
            node = up[node]
        assert {b for b in at if below(a, b)} == above


@pytest.mark.parametrize("at_once", [1, 7, 1000])
def test_scan_of_nested_intervals_equals_brute_force(monkeypatch, at_once):
    """rows come in batches, and intervals stay open from one to the next."""
    monkeypatch.setattr(types, "SCANNED", at_once)
    rng = random.Random(at_once)
    rows = []
    for name in "abc":
        up = [None] + [rng.randrange(max(0, i - 3), i) for i in range(1, 60)]
        below = {i: [c for c in range(60) if up[c] == i] for i in range(60)}
        span = {}

        def number(i, at, below=below, span=span):
            last = at
            for c in below[i]:
                last = number(c, last + 1)
            span[i] = (at, last)
            return last

        number(0, 0)
        rows += [(name, a, 0, b, rng.randrange(1, 5), rng.randrange(100), None) for a, b in span.values() if rng.random() < 0.6 for _ in range(rng.randrange(1, 3))]
        rows += [(name, rng.randrange(62), 1, 0, 0, 0, f"t{k}") for k in range(40)]
    rows.sort(key=lambda r: r[:3])
    schema = pa.schema([("method_name", pa.string()), *((c, pa.int64()) for c in ("at", "kind", "post", "n", "number")), ("type", pa.string())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + 10]], schema=schema) for i in range(0, len(rows), 10)]
    got = []
    for asked, sums, least in types._scanned(iter(batches), "method_name"):
        if sums is not None:
            got += zip(asked.column("method_name").to_pylist(), asked.column("type").to_pylist(), sums.tolist(), least.tolist(), strict=True)
    wanted = []
    for name, at, kind, *_, type_ in rows:
        if kind:
            held = [r for r in rows if r[0] == name and r[2] == 0 and r[1] <= at <= r[3]]
            wanted.append((name, type_, sum(r[4] for r in held), min((r[5] for r in held), default=0)))
    assert sorted(got) == sorted(wanted)


def test_intervals_are_sorted_once(spark, monkeypatch):
    """what is written and scanned again grows with questions and ranges, not with declarations; one name fills all ranges."""
    written = []

    def cut(df):
        out = types_cut(df)
        if {"at", "post"} <= set(out.columns):
            written.append(out.count())
        return out

    types_cut = types.cut
    monkeypatch.setattr(types, "cut", cut)
    classes = [(f"C{i:03}", f"C{i // 2:03}" if i > 1 else None, []) for i in range(1, 400)]
    methods = [(c, "m", f"f{k}", k) for c, _, _ in classes for k in range(2)]
    found = spark.createDataFrame(classes, "class_name string, extends string, implements array<string>")
    declared = spark.createDataFrame(methods, "class_name string, method_name string, file_path string, line int")
    asked = spark.createDataFrame([(i, "m", f"C{i:03}", 0) for i in (1, 5, 77, 200, 399)], "call_id int, method_name string, receiver_type string, n_args int")
    got = {r.call_id: (r.n, r.first_class) for r in types.target_counts(asked, found, declared).collect()}
    assert got == {i: (2 * i.bit_length(), "C001") for i in (1, 5, 77, 200, 399)}
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert written
    assert sum(written) <= 5 + ranges * (1 + 9)
