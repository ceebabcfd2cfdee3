import random

from pyspark.sql import functions as F

from lodestone.operators.rangescan import running


def test_running_values_equal_a_plain_scan_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice([None, "a", "b", "c", ""]), rng.randint(0, 10**6), i, rng.choice([None, f"v{i}"]), rng.randint(-9, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "g string, at long, tie long, v string, x long").repartition(5)
    got = running(df, ["g"], ["at", "tie"], {"last": ("last", F.col("v")), "total": ("sum", F.col("x")), "mixed": ("xor", F.col("x")), "place": ("sum", F.lit(1))}, ranges=7)
    state, wanted = {}, {}
    for g, at, tie, v, x in sorted(rows, key=lambda r: (r[1], r[2])):
        last, total, mixed, place = state.get(g, (None, 0, 0, 0))
        state[g] = (v if v is not None else last, total + x, mixed ^ x, place + 1)
        wanted[tie] = state[g]
    assert {r.tie: (r.last, r.total, r.mixed, r.place) for r in got.collect()} == wanted


def test_a_hot_group_lies_in_many_ranges(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("g"), "id")
    from lodestone.operators import rangescan

    seen = []
    real = rangescan.cut
    rangescan.cut = lambda d: seen.append(real(d)) or seen[-1]
    try:
        out = running(df, ["g"], ["id"], {"n": ("sum", F.lit(1))}, ranges=8)
        assert out.filter("g = 'hot'").agg(F.max("n")).first()[0] == 10_000
    finally:
        rangescan.cut = real
    sizes = [r["count"] for r in seen[0].groupBy("__range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    assert seen[1].count() <= 8  # what is carried


def test_descending_order_nulls_and_an_empty_table(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 3, 2), ("a", 5, 4), (None, 1, 8)], "g string, at int, x int")
    got = {(r.g, r.at): r.s for r in running(df, ["g"], [F.col("at").desc_nulls_last()], {"s": ("sum", F.col("x"))}, ranges=3).collect()}
    assert got == {("a", 5): 4, ("a", 3): 6, ("a", None): 7, (None, 1): 8}
    assert running(df.limit(0), ["g"], ["at"], {"s": ("sum", F.col("x"))}).collect() == []
