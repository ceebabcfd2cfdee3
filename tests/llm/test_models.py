import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import gru, license_scan, recurrent_lm, winnow
from lodestone.llm.license_scan import license_statements
from lodestone.llm.quality_qda import FEATURES, discriminant, keep_quality, quality_scores
from lodestone.llm.recurrent_lm import lm_scores
from lodestone.llm.warc import archive_index, archive_pages, read_archive, write_archive
from lodestone.llm.winnow import contamination, decontaminate


def test_gradients():
    rng = np.random.default_rng(0)
    shape = gru.Shape.of(np.array([50, 40, 30, 20, 10, 9, 8, 7, 6, 5.0]), 3, 5, alone=2)
    p = {k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in gru.initial(shape).items()}
    inputs, targets = rng.integers(0, 10, (6, 4)), rng.integers(0, 10, (6, 4))
    resets, active, state = rng.random((6, 4)) < 0.2, rng.random((6, 4)) < 0.8, rng.normal(0, 0.5, (4, 5))
    g = gru.loss_gradient(p, shape, inputs, targets, resets, state, active)[1]
    for k, v in p.items():
        for _ in range(3):
            i = tuple(rng.integers(0, n) for n in v.shape)
            old, losses = v[i], []
            for e in (1e-5, -1e-5):
                v[i] = old + e
                losses.append(gru.loss_gradient(p, shape, inputs, targets, resets, state, active)[0])
            v[i] = old
            assert abs((losses[0] - losses[1]) / 2e-5 - g[k][i]) < 1e-3 * max(1, abs(g[k][i]))


def test_probabilities_sum_to_one_and_lanes_do_not_matter():
    rng = np.random.default_rng(3)
    shape = gru.Shape.of(np.arange(30, 0, -1.0), 4, 6, alone=0)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in gru.initial(shape).items()}
    state = rng.normal(0, 1, (1, 6)).astype(np.float32)
    total = sum(math.exp(gru.log_probability(p, shape, state, np.array([t]))[0]) for t in range(30))
    assert abs(total - 1) < 1e-4
    documents = [rng.integers(0, 30, n).astype(np.int32) for n in (50, 1, 7, 33, 2)]
    one = gru.score(p, shape, documents, 0)
    assert np.allclose(one, gru.score(p, shape, documents, 0, lanes=2, window=3), atol=1e-3)
    assert np.allclose(one, [gru.score(p, shape, [d], 0)[0] for d in documents], atol=1e-3)


def test_softmaxes_of_all_classes_share_their_steps(monkeypatch):
    calls, exp = [], np.exp
    monkeypatch.setattr(gru.np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    rng, made = np.random.default_rng(3), []
    for classes in (4, 40):
        shape = gru.Shape.of(np.arange(200, 0, -1.0), classes, 4)
        gru.log_probability(gru.initial(shape), shape, rng.normal(0, 0.5, (300, 4)).astype(np.float32), rng.integers(0, 200, 300))
        made.append(len(calls))
    assert made == [2, 4]  # one over the classes and one within all of them


def test_rows_of_an_item_are_added_up():
    rng = np.random.default_rng(4)
    for most in (1, 3, 50, 400):
        items, rows = np.minimum(rng.integers(0, most, 300), rng.integers(0, most, 300)), rng.normal(size=(300, 5))
        found, sums = gru._summed(rows, items, most)
        assert sorted(found.tolist()) == sorted(set(items.tolist()))
        assert all(np.allclose(s, rows[items == i].sum(axis=0)) for i, s in zip(found, sums, strict=True))


def test_words_of_odd_texts():
    texts = ["", " \t\r\n", "A b", " x  Y\x0b\x0cz ", "a\x1cb\x85c\xa0D É", "\x00 \x00", None, "tail\n"]
    lengths, words = recurrent_lm.words_in(pa.array(texts))
    wanted = [(t or "").encode().lower().split() for t in texts]
    assert lengths.tolist() == [len(w) for w in wanted] and words.to_pylist() == [x for w in wanted for x in w]
    got = recurrent_lm.sequences_of(lengths, recurrent_lm.places_in(words, pa.array([b"b", b"a"], pa.binary())), 9)
    assert [g.tolist() for g in got] == [[*({b"b": 0, b"a": 1}.get(x, 2) for x in w), 9] for w in wanted]


def test_training_helps_and_base_scores_are_exact(spark):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["a b c d", "e f g h", "rare%d" % rng.randrange(99)]) for _ in range(40))) for i in range(120)] + [(500, None), (501, ""), (None, "a b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = lm_scores(docs, vocabulary=20, known_words=40, hidden=8, classes=4, rounds=3, parts=1).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    words = {i: (t or "").encode().lower().split() + [None] for i, t in texts}
    counts = Counter(w for i, ws in words.items() if i is not None and not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for r in got:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held[r.doc_id], len(ws), n, sum(w in counts for w in ws))
        assert abs(r.base_score - sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_without_training_rows(spark, empty):
    assert lm_scores(empty).count() == 0
    row = lm_scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.held_out) == (3, 0, 0, 0.0, False)


def test_discriminant_is_the_textbook_one():
    rng = np.random.default_rng(4)
    x = {0: rng.normal(0, 1, (400, 3)) @ np.diag([1, 2, 0.5]), 1: rng.normal(1, 1, (600, 3))}
    model = discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}, 0.0, 1e-9)
    for k, v in x.items():
        covariance, mean = np.cov(v.T, bias=True), v.mean(axis=0)
        d = v[:5] - mean
        density = -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(covariance), d) - 0.5 * np.linalg.slogdet(covariance)[1]
        assert np.allclose(model.log_density(k, v[:5]), density, atol=1e-4)


def test_quality(spark, docs, rows, empty):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "over", "green", "fields", "and", "sings"]) for _ in range(rng.randint(20, 90))) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "###", "BUY", "!!", "NOW%%"]) for _ in range(rng.randint(20, 90)))
    texts = [(i, good() if i % 3 else bad()) for i in range(600)] + [(900, None), (901, ""), (None, "word")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in quality_scores(table, labels).collect()}
    held = [r for i, r in got.items() if r.held_out and i is not None and i < 600]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and not got[None].held_out
    assert abs(got[900].score - got[901].score) < 1e-12
    left = keep_quality(table, labels)
    assert left.columns == table.columns and 350 < left.count() < 450
    assert quality_scores(empty, labels).count() == 0 and len(FEATURES) == 14
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs, labels).count() == len(rows)


def brute(texts, items):
    windows = {}
    for k, t in items:
        w = winnow.words_of((t or "").encode())
        for at in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[at : at + 10]), set()).add(k)
    for i, t in texts:
        w, hit, found = winnow.words_of((t or "").encode()), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if tuple(w[at : at + n]) in windows:
                    hit |= set(range(at, at + n))
                    found |= windows[tuple(w[at : at + n])]
        yield i, len(w), len(hit), sorted(found)


def test_winnowing_equals_brute_force(spark, docs, rows, empty):
    items = [(1, "Zeta, eta theta iota kappa lambda mu nu xi omicron pi"), (2, "quick BROWN fox"), (3, None), (4, "..."), (5, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x0 w14x1 w15x2 w16x3"), (5, "one"), (2, "quick BROWN fox")]
    table = spark.createDataFrame(items, "item_id long, text string, extra string".replace(", extra string", ""))
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in contamination(docs, table).collect()]
    wanted = list(brute(rows, items))
    assert sorted(got, key=str) == sorted(wanted, key=str) and sum(x[2] > 0 for x in wanted) > 5
    left = decontaminate(docs, table)
    assert left.columns == docs.columns and left.count() == sum(x[2] == 0 for x in wanted)
    assert contamination(docs, table.limit(0)).filter("n_hit > 0").count() == 0 == contamination(empty, table).count()


def test_random_texts_miss_no_shared_span(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefg")
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 30)))) for k in range(12)]
    texts = [(i, " ".join([*(word() for _ in range(rng.randint(0, 20))), *rng.choice(items)[1].split()[: rng.randint(5, 14)], *(word() for _ in range(rng.randint(0, 20)))])) for i in range(60)]
    got = contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()) == sorted(brute(texts, items))


def test_licenses(docs, rows, empty):
    got = {r.doc_id: r for r in license_statements(docs).collect()}
    assert [s.license for s in got[13].statements] == ["MIT"] and got[13].statements[0].saved > 0
    assert got[4].n_blocks == 0 and license_statements(empty).count() == 0
    changed = license_scan.TEMPLATES["ISC"][0].replace("modify", "alter")
    text = f"Words before. {changed} Words after. Licensed under the Apache License, Version 2.0."
    n, found = license_scan.scan(text.encode())
    assert n == 1 and [(s["license"], len(s["differences"])) for s in found] == [("ISC", 1), ("Apache-2.0", 0)]
    assert found[0]["differences"] == [{"template": "modify", "text": "alter"}]
    assert license_scan.scan(b"Released under the GPL License.")[1] == []
    assert len(license_scan.scan((b"filler word " * 3000 + b"Released under the MIT License. ") * 3)[1]) == 3


def test_warc(spark, tmp_path):
    rows = [(1, "u1", "x" * 200), (2, None, "x" * 200), (3, "a\r\nb", "short"), (4, "u", "short"), (5, "u", None), (None, "u", "x" * 200), (1, "u1", "x" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = archive_pages(pages).collect()
    assert len(got) == len(rows)
    by = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert [x for x in by if x[3] == 200] == [(0, "revisit", 1, 200), (1, "response", None, 200), (1, "revisit", 1, 200), (2, "revisit", 1, 200)]
    assert all(x[1] == "response" for x in by if x[3] < 100)
    write_archive(pages, str(tmp_path / "w"))
    records = read_archive(spark, str(tmp_path / "w")).collect()
    assert all(r.verified for r in records) and spark.read.parquet(str(tmp_path / "w/payloads")).count() == 3
    for r in records:
        head, _, body = bytes(r.record).partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0]) == len(body) - 4
        assert b"\r\nWARC-Date: " in head
    odd = spark.createDataFrame([("a>\r\nb", "u", "y" * 3_000_000), ("é %2F", None, "y" * 3_000_000), ("c", "u", None)], "page_id string, url string, html string").selectExpr("*", "'x' AS record_type", "1 AS payload_bytes")
    assert sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in archive_pages(odd).collect()) == [("a>\r\nb", "response", None, 3_000_000), ("c", "response", None, 0), ("é %2F", "revisit", "a>\r\nb", 3_000_000)]
    write_archive(pages.limit(0), str(tmp_path / "e"))
    assert archive_index(spark, str(tmp_path / "e")).count() == 0


def test_scores_token_by_token(spark):
    """The score of a document from its words, one at a time, in plain arithmetic of doubles."""
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choice(["a b", "c d e", "f", "rare%d" % rng.randrange(30)]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    words = {i: t.lower().split() for i, t in texts}
    train = [w for i, w in words.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(x for w in train for x in w)
    chosen = sorted(counts, key=lambda w: (-counts[w], w))[:6]
    rare_n, rare_v = sum(c for w, c in counts.items() if w not in chosen), len(counts) - len(chosen)
    named = sorted([(len(train), ""), (rare_n, " "), *((counts[w], w) for w in chosen)], key=lambda x: (-x[0], x[1]))
    number = {w: k for k, (_, w) in enumerate(named)}
    shape = gru.Shape.of(np.array([c for c, _ in named], float), 3, 4, alone=number[" "])
    trainer = gru.Trainer(gru.initial(shape), shape, number[""], lanes=4)
    for w in train:
        trainer.add(np.array([*(number.get(x, number[" "]) for x in w), number[""]], np.int32))
    trainer.finish()
    assert trainer.tokens == sum(len(w) + 1 for w in train)  # every word is trained on once
    p = {k: v.astype(np.float64) for k, v in trainer.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    soft = lambda x: np.exp(x) / np.exp(x).sum()
    total = []
    for w in words.values():
        h, log, given = np.zeros(4), 0.0, number[""]
        for x in [*(number.get(x, number[" "]) for x in w), number[""]]:
            e = p["input"][given]
            z, r = sigmoid(e[:4] + h @ p["gates"][:, :4]), sigmoid(e[4:8] + h @ p["gates"][:, 4:])
            h = (1 - z) * h + z * np.tanh(e[8:] + (r * h) @ p["state"])
            k = shape.class_of[x]
            a, b = shape.bounds[k], shape.bounds[k + 1]
            log += math.log(soft(h @ p["to_class"] + p["class_bias"])[k]) + math.log(soft(p["to_word"][a:b] @ h + p["word_bias"][a:b])[x - a])
            given = x
        total.append(log)
    sequences = [np.array([*(number.get(x, number[" "]) for x in w), number[""]], np.int32) for w in words.values()]
    assert np.allclose(gru.score(trainer.p, shape, sequences, number[""]), total, rtol=1e-4, atol=1e-3)
    assert lm_scores(docs, vocabulary=6, known_words=50, hidden=4, classes=3).count() == 60


def test_language_model_on_awkward_rows(docs, rows):
    got = lm_scores(docs, vocabulary=30, known_words=100, hidden=4, classes=4).collect()
    assert len(got) == len(rows) and all(math.isfinite(r.score) and r.score <= 0 for r in got if r.doc_id is not None)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_tokens), set()).add((round(r.base_score, 6), round(r.score, 2)))
    assert len(by[(0, 17)]) == 1  # repeated rows score alike
    try:
        lm_scores(docs, rounds=1, parts=2)
        raise AssertionError("words that no round trains on")
    except ValueError:
        pass


def test_statistics_of_brute_force():
    from lodestone.llm.quality_qda import statistics

    text = "The The cat SAT!! on 12 mats.\nThe cat\n\nThe cat\n$$x"
    values, n = statistics(text.encode())
    words, lines = text.lower().split(), [x.strip() for x in text.split("\n") if x.strip()]
    assert n == len(words) == 12 and len(values) == len(FEATURES)
    count = lambda test: sum(map(test, text))
    assert abs(values[0] - math.log((count(lambda c: "A" <= c <= "Z") + 1) / (count(lambda c: "a" <= c <= "z") + 20))) < 1e-12
    assert abs(values[2] - math.log((count(str.isdigit) + 0.5) / (len(text) + 50))) < 1e-12
    assert abs(values[5] - math.log((n - len(set(words)) + 2) / (n + 10))) < 1e-12
    assert abs(values[6] - math.log((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 2))) < 1e-12
    assert abs(values[8] - math.log((sum(a == b for a, b in zip(words, words[1:])) + 0.5) / (n + 20))) < 1e-12
    assert abs(values[10] - sum(map(len, words)) / n) < 1e-12


@pytest.mark.parametrize("steep", [0.3, 40.0])
def test_scores_equal_a_plain_recurrence(steep):
    """Whatever the weights: document by document, token by token, with the softmax written out."""
    rng = np.random.default_rng(7)
    shape = gru.Shape.of(np.arange(40, 0, -1).astype(float), 5, 6, alone=3)
    p = {k: rng.normal(0, steep if k.startswith("to_") else 0.3, v.shape).astype(np.float32) for k, v in gru.initial(shape).items()}
    documents = [rng.integers(0, 40, n).astype(np.int32) for n in (1, 9, 30, 4, 17)]
    got = gru.score(p, shape, documents, 2, lanes=2, window=3)
    q, wanted = {k: v.astype(float) for k, v in p.items()}, []
    for ids in documents:
        h, last, total = np.zeros(6), 2, 0.0
        for x in ids:
            given = q["input"][last]
            gates = 1 / (1 + np.exp(-(given[:12] + h @ q["gates"])))
            c = np.tanh(given[12:] + (gates[6:] * h) @ q["state"])
            h = h + gates[:6] * (c - h)
            k = shape.class_of[x]
            a, b = shape.bounds[k], shape.bounds[k + 1]
            for scores, at in ((h @ q["to_class"] + q["class_bias"], k), (q["to_word"][a:b] @ h + q["word_bias"][a:b], x - a)):
                total += scores[at] - scores.max() - np.log(np.exp(scores - scores.max()).sum())
            last = x
        wanted.append(total)
    np.testing.assert_allclose(got, wanted, rtol=2e-4)
