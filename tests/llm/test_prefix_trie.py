import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import prefix_trie as module
from lodestone.llm.prefix_trie import prefix_trie, roll_up


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turn_digest = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0, turn_digest), (role or "", text or "")))
    convs = {c: [t for _, t in sorted(v)] for c, v in convs.items()}
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, cs in members.items():
        subtree = [u for u in members if u[: len(node)] == node]
        children = [u for u in subtree if len(u) == len(node) + 1]
        leaves = [u for u in subtree if not any(w[: len(u)] == u and len(w) == len(u) + 1 for w in subtree)]
        saved = sum((len(members[u]) - 1) * len(u[-1][1]) for u in subtree if u)
        ends = ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(node))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=260, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(n + 60), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "assistant", None]) if t > 1 else "user", rng.choice(["hi", "", None, "é中", "long " * 5]) if t else rng.choice(["hello", "hi"]), "x"))
    return rows + [(None, 0, "user", "lost", "x"), (100, 1, "user", "again", "x"), (100, 1, "user", "again", "x")]


SCHEMA = "conv_id long, turn long, role string, text string, node string"


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(module, "IDS_A_ROW", 3)
    rows = rows_of(seed)
    got = prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_deep_copies_turnless_and_empty(spark):
    deep = [(0, t, "user", f"turn {t}", "x") for t in range(70)]
    copies = [(c, t, "user", f"turn {t}", "x") for c in (1, 2, 300, 301) for t in range(70)] + [(c, t, "a", "b", "x") for c in range(450, 470) for t in range(2)]
    got = prefix_trie(spark.createDataFrame(deep + copies, SCHEMA))
    wanted = brute(deep + copies)
    assert any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in wanted)  # some end at the root
    assert sorted(map(tuple, got.collect()), key=str) == wanted
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, None, None, None, None)], SCHEMA)).collect() == []


def test_a_chain_rolls_up_in_logarithmic_rounds(spark, monkeypatch):
    rounds = []
    real = module.written
    monkeypatch.setattr(module, "written", lambda df, tag: rounds.append(tag) or real(df, tag))
    n = 3000
    chain = spark.range(n + 1).select(F.when(F.col("id") == 0, "root").otherwise(F.col("id").cast("string")).alias("node"), F.when(F.col("id") == 1, "root").when(F.col("id") > 1, (F.col("id") - 1).cast("string")).alias("parent"), F.col("id").alias("depth"), F.lit(1).cast("long").alias("x"))
    got = {r.node: r.x for r in roll_up(chain, ["x"]).collect()}
    assert got["root"] == n + 1 and got["1"] == n and got[str(n)] == 1 and got["1000"] == n - 999
    assert rounds.count("trie-more") == 12
