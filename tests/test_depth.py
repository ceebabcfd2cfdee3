from lodestone.operators import callgraph, taint


def test_taint_passes_any_number_of_calls(spark):
    seeds = spark.createDataFrame([("m0", "x", "cookie", "f:1", [])], "uid string, var string, source_type string, source_loc string, path array<string>")
    calls = [(f"m{i}", f"m{i + 1}", ["x" if i == 0 else "param_0"]) for i in range(24)] + [("m24", "m0", ["param_0"])]
    got = taint.propagated(seeds, spark.createDataFrame(calls, "caller_uid string, callee_uid string, args array<string>"))
    assert {(r.uid, r.var, len(r.path)) for r in got.collect()} == {("m0", "x", 0), ("m0", "param_0", 25)} | {(f"m{i}", "param_0", i) for i in range(1, 25)}


def test_superclasses_go_to_the_root(spark):
    hierarchy = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(18)], "child string, parent string")
    starts = spark.createDataFrame([("c0",)], "s string")
    assert {(r.node, r.depth) for r in callgraph.superclasses(hierarchy, starts).collect()} == {(f"c{i}", i) for i in range(1, 19)}
    walk = callgraph.reached(hierarchy.toDF("caller_uid", "callee_uid"), starts)
    assert max(r.depth for r in walk.collect()) == 10
