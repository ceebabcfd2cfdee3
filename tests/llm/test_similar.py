import random

import pytest

import corpus_pipeline
from lodestone.llm.similar import drop_similar, fingerprint_pairs
from lodestone.llm.simhash import fingerprint


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def kept_by_brute_force(rows):
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def copies():
    rng, rows = random.Random(3), []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(6):
            for at in rng.sample(range(200), rng.randint(1, 5)):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    return rows + [(100, ""), (101, None), (102, " \n"), (103, "one two"), (104, "ONE  two"), (105, "three")]


def test_pipeline_drops_copies_of_similarity_that_fingerprints_miss(spark):
    rows = copies()
    far = [(a, b) for k, a in enumerate(rows[:72]) for b in rows[k + 1 : 72] if len(shingle_set(a[1]) & shingle_set(b[1])) >= 0.8 * len(shingle_set(a[1]) | shingle_set(b[1])) and (fingerprint(a[1].encode()) ^ fingerprint(b[1].encode())).bit_count() > 4]
    assert len(far) > 20
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, table, "").collect()) == kept_by_brute_force(rows)


def test_fingerprints_give_candidates(spark):
    """Their pairs join what all pairs of fingerprints within four bits join."""
    rows = copies()
    prints = [(i, fingerprint((t or "").encode(), 5)) for i, t in rows]

    def groups(pairs):
        parent = {i: i for i, _ in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        return sorted(sorted(i for i in parent if find(i) == k) for k in parent if find(k) == k)

    wanted = [(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 4]
    assert len(wanted) > 20
    table = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in prints], "node long, fp long")
    assert groups([tuple(r) for r in fingerprint_pairs(table).collect()]) == groups(wanted)


@pytest.mark.parametrize("cell_texts", [1024, 3])
def test_buckets_dealt_over_cells_give_the_same(spark, cell_texts):
    rows = copies()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_similar(table, cell_texts=cell_texts).collect()) == kept_by_brute_force(rows)


def test_rows_repeated_null_and_none(docs, rows, empty):
    left = drop_similar(docs)
    named = [(i, t) for i, t in rows if i is not None]
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == kept_by_brute_force(dict(named).items())
    assert drop_similar(empty).count() == 0
