import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import components, simhash
from lodestone.llm.exact_dedup import exact_dedup, exact_groups
from lodestone.llm.simhash import drop_near_duplicates, near_duplicates
from lodestone.llm.substring_dedup import index_shard, remove_repeats
from lodestone.llm.fm_index import FMIndex, WaveletMatrix


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", "", text or "")


def test_exact_groups_equal_brute_force(docs, rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append((-len(t or ""), i is None, i))
    got = exact_groups(docs, carry=["doc_id", "text", "a b"]).collect()
    assert len(got) == len(rows)
    for r in got:
        best = min(groups[normal(r.text)], key=lambda x: (x[0], x[1], x[2] or 0))
        assert (r.keep_id, r.group_size) == (best[2], len(groups[normal(r.text)]))
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({normal(r.text) for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_keeps_columns_and_one_row_each(docs, rows):
    left = exact_dedup(docs)
    assert left.columns == docs.columns
    got = [normal(r.text) for r in left.collect()]
    assert len(got) == len(set(got)) == len({normal(t) for _, t in rows})


def test_short_prefixes_give_the_same(docs):
    one = sorted(map(str, exact_groups(docs, carry=["doc_id"]).collect()))
    assert one == sorted(map(str, exact_groups(docs, carry=["doc_id"], prefix_chars=1).collect()))


def test_fingerprint_of_brute_force():
    def slow(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", text.lower())
        shingles = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    for text in (b"", b" \n", b"a", b"A b C d", "Éà b c d e f É".encode(), b"a b c d e f g " * 30):
        assert simhash.fingerprint(text) == slow(text)


def test_spark_hash_is_the_shingle_hash(spark):
    value = spark.sql("SELECT xxhash64('a b c d') AS h").first().h
    assert value % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def classes(pairs, items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_links_have_the_components_of_all_pairs(spark, bucket_rows):
    rng = random.Random(bucket_rows)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for x in list(fps)[:20]:
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    wanted = classes([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 4], fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket_rows=bucket_rows).collect()
    pairs = [(r.a % 2**64, r.b % 2**64) for r in found]
    assert all((a ^ b).bit_count() <= 4 for a, b in pairs)
    assert classes(pairs, fps) == wanted


def test_near_duplicates(docs, rows):
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    ids = [i for i, _ in rows if i is not None]
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows if i is not None}
    wanted = classes([(a, b) for a in ids for b in ids if (prints[a] ^ prints[b]).bit_count() <= 4], set(ids))
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.fingerprint) == (wanted[r.doc_id], f"{prints[r.doc_id]:016x}")
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(wanted.values()))


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(5, 5), (7, 6)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 37, 500)
    tree = WaveletMatrix(symbols.copy(), 37)
    c, left, right = rng.integers(0, 37, 200), rng.integers(0, 501, 200), rng.integers(0, 501, 200)
    a, b = tree.ranks(c, left, right)
    assert all(x == (symbols[:i] == k).sum() for x, k, i in zip(a, c, left)) and all(x == (symbols[:i] == k).sum() for x, k, i in zip(b, c, right))


def test_matching_statistics_of_any_pattern():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 4, n) for n in (20, 9, 14)]
    index = FMIndex(np.concatenate([np.append(t, 0) for t in texts]), 5)
    patterns = rng.integers(-1, 5, (8, 12))
    patterns[patterns == 0] = -1
    patterns[patterns == 4] = -1  # unknown words
    lengths = np.array([12, 11, 12, 3, 0, 7, 12, 12])
    whole = [tuple(t.tolist()) for t in texts]
    occurs = lambda p: any(t[i : i + len(p)] == p for t in whole for i in range(len(t)))
    for rows, position, matched, _ in index.matching_statistics(patterns, lengths):
        for r, at, m in zip(rows, position, matched):
            p = tuple(patterns[r, at : lengths[r]].tolist())
            assert m == max(k for k in range(min(5, len(p)) + 1) if k == 0 or occurs(p[:k]))


def test_index_shard():
    texts = [b"a b c d e", b"b c d", b"x a b c"]
    assert [x.tolist() for x in index_shard(texts, np.array([5, 3, 4]), 3)] == [[4, 3, 5], [3], [4, 4]]


def test_substrings_equal_brute_force(docs, rows):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - 12):
            if i is not None:
                first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), i), i)
    wanted = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone |= set(range(k, k + 13))
        wanted.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    for shard in (400_000, 20):
        got = [tuple(r) for r in remove_repeats(docs, shard_words=shard).collect()]
        assert sorted(got, key=str) == sorted(wanted, key=str)
    assert any(n for _, _, n, _ in wanted)


def test_empty_tables(empty):
    assert exact_groups(empty).count() == exact_dedup(empty).count() == near_duplicates(empty).count() == drop_near_duplicates(empty).count() == remove_repeats(empty).count() == 0
