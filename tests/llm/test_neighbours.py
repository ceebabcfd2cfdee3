import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours, partition_router
from lodestone.llm.neighbours import nearest_vectors, n_parts

SCHEMA = "vec_id long, embedding array<float>, label int, score double, part int"


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, 0.5, 1) for i, v in rows], SCHEMA.replace("<float>", f"<{kind}>"))


def brute(rows, ids, k):
    """query to its k best (score, id)."""
    x = {i: np.array(v, np.float64) for i, v in rows}
    return {q: sorted(((-float(x[q] @ v), i) for i, v in x.items() if i != q))[:k] for q in ids}


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append(r)
    for q, found in out.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, len(found) + 1))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found) and all(r.vec_id != q for r in found)
    return out


def recall(got, wanted, k):
    return float(np.mean([len({r.vec_id for r in got[q]} & {i for _, i in best}) / k for q, best in wanted.items()]))


def vectors(kind, n, d, seed):
    rng = np.random.default_rng(seed)
    if kind == "even":
        x = rng.normal(size=(n, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    elif kind == "lengths":
        x = rng.normal(size=(n, d)) * rng.lognormal(0, 0.5, (n, 1))
    else:
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, d))
        x[: n // 3] = x[0] + 1e-3 * rng.normal(size=(n // 3, d))  # a third are near copies
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x.astype(np.float32))]


@pytest.mark.parametrize("kind", ["even", "lengths", "clusters"])
def test_recall_against_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 1500)
    monkeypatch.setattr(neighbours, "SLAB_ROWS", 300)
    monkeypatch.setattr(neighbours, "PART_ROOT", 4)
    rows = vectors(kind, 3000, 24, 3)
    got = results(nearest_vectors(table(spark, rows).repartition(3), F.col("vec_id") % 20 == 0))
    wanted = brute(rows, range(0, 3000, 20), 20)
    assert set(got) == set(wanted) and all(len(r) == 20 for r in got.values())
    assert recall(got, wanted, 20) >= 0.93
    exact = {i: np.array(v, np.float64) for i, v in rows}
    assert all(math.isclose(r.score, exact[q] @ exact[r.vec_id], rel_tol=1e-12, abs_tol=1e-12) for q, found in got.items() for r in found)


def test_routing_leaves_parts_out(spark):
    x = np.array([v for _, v in vectors("clusters", 3000, 24, 5)])
    router = partition_router.fit(x, float(np.linalg.norm(x, axis=1).max()), 16, 20)
    assert router.n_parts == 16 and router.probes(x).mean() < 0.6
    size = np.bincount(router.part(x), minlength=16)
    assert (size > 0).sum() >= 8


def test_copies_ties_and_vectors_that_take_no_part(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(200)] + [(200 + i, [float(i % 7), 1.0, -1.0]) for i in range(50)]
    odd = [(300, None), (320, [0.0, 0.0, 0.0]), (340, [1.0, None, 0.0]), (360, [float("nan"), 1.0, 1.0]), (380, [float("inf"), 1.0, 1.0]), (400, [1.0, 2.0]), (420, []), (None, [9.0, 9.0, 9.0]), (40, rows[40][1])]
    got = results(nearest_vectors(table(spark, rows + odd).repartition(2), F.col("vec_id") % 20 == 0))
    assert {q: [(-r.score, r.vec_id) for r in found] for q, found in got.items()} == brute(rows, range(0, 250, 20), 20)


def test_doubles_few_rows_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0]), (20, [1e-3, 1.0]), (7, [-5.0, 0.1])]
    got = results(nearest_vectors(table(spark, rows, "double"), F.col("vec_id") % 20 == 0))
    assert {q: [(-r.score, r.vec_id) for r in found] for q, found in got.items()} == brute(rows, [0, 20], 20)
    for none in ([], [(5, None)], [(20, [1.0])]):
        assert nearest_vectors(table(spark, none), F.col("vec_id") % 20 == 0).collect() == []


def test_parts_grow_with_the_root_and_stop():
    assert [n_parts(n) for n in (0, 500, 10_000, 51_000, 10**6, 10**9)] == [4, 4, 8, 16, 64, 128]


def test_parts_of_the_graph_are_balanced():
    x = np.array([v for _, v in vectors("clusters", 2000, 12, 9)])
    graph = partition_router.nearest(x, x, 10)
    part = partition_router.balanced_parts(x, graph, 8, np.random.default_rng(1))
    size = np.bincount(part, minlength=8)
    assert size.max() <= math.ceil(1.05 * 2000 / 8)
