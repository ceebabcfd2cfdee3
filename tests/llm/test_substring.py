import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm.substring_dedup import Cut, index_shard, remove_repeats
from lodestone.llm.wordhash import Runs, chunks, smallest, texts_of_column, word_hashes, word_spans


def brute(rows, window=13):
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), i), i)
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def test_words_and_hashes_of_batches():
    texts = [b"a bb  ccc\n", b"", b" \t ", b"dd", b"e" * 70 + b" f " + "Éà　x".encode(), b"12345678 123456789", b"dd"]
    held = texts_of_column(pa.array([b"x", *texts], pa.binary()).slice(1))
    first, end, counts = word_spans(held)
    words = [bytes(held.data[a:b]) for a, b in zip(first, end)]
    assert words == [w for t in texts for w in t.split()] and counts.tolist() == [len(t.split()) for t in texts]
    hashes = word_hashes(held.data, first, end)
    assert len(set(hashes.tolist())) == len(set(words)) and hashes[words.index(b"dd")] == hashes[-1]
    runs = Runs(hashes)
    assert all(len(runs.of(n)) == max(0, len(words) - n + 1) for n in (1, 2, 3, 5, 8, 13, 99))
    assert smallest(np.array([3, 1, 1, 5, 0], np.uint64), 3).tolist() == [2, 2, 4]


def test_chunks_hold_all_rows_in_order():
    texts = ["x" * n for n in (0, 5, 300, 2, 2, 2, 90, 0, 0, 7)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, min(a + 4, 10))), pa.array(texts[a : a + 4])], ["i", "t"]) for a in (0, 4, 8)]
    found = [(i, int(n)) for c in chunks(iter(batches), 50) for i, n in zip(c.columns[0].tolist(), np.diff(c.offsets))]
    assert found == [(i, len(t)) for i, t in enumerate(texts)]


def test_equal_windows_have_equal_keys():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))).encode() for _ in range(30)]
    cut = Cut(texts_of_column(pa.array(texts, pa.binary())), 7, 4)
    keys, windows = {}, 0
    for row, first, n, key in zip(cut.row, cut.first, cut.windows, cut.key):
        for k in range(first, first + n):
            windows += 1
            assert keys.setdefault(tuple(texts[row].split()[k : k + 7]), key) == key
    assert windows == sum(max(0, len(t.split()) - 6) for t in texts)


@pytest.mark.parametrize("options", [{}, {"hot": 20, "shard_words": 300}])
def test_a_common_phrase_between_ever_different_words(spark, options):
    """Eight words that thousands of documents share, alone or in longer passages, before and after words of their own."""
    rng = random.Random(5)
    phrase = "the terms of this notice apply to all"
    longer = f"please note that {phrase} who read it here"
    word = lambda: f"w{rng.randrange(40)}"
    rows = [(i, " ".join([*(word() for _ in range(rng.randint(0, 9))), rng.choice([phrase, phrase, longer]), *(word() for _ in range(rng.randint(0, 9)))])) for i in range(3000)]
    rows += [(4000 + i, "a a a a " * rng.randint(1, 12)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    got = sorted(tuple(r) for r in remove_repeats(docs, **options).collect())
    wanted = brute(rows)
    assert got == wanted and sum(x[2] > 0 for x in wanted) > 500


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        remove_repeats(spark.createDataFrame([("x", "a b")], "doc_id string, text string"))


def test_index_shard_takes_the_least_id():
    assert [x.tolist() for x in index_shard([b"a b c d e", b"b c d", b"x a b c"], np.array([5, 3, 4]), 3)] == [[4, 3, 5], [3], [4, 4]]
