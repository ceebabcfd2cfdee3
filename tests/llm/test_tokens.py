import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm.packing import cut, pack, plan
from lodestone.llm.token_orc import read_tokens, token_index, tokenize, write_tokens
from lodestone.llm.tokens import BYTE_LEVEL, WORD_LEVEL, encoder, public_path

MODELS = {"byte_bpe_50k.json": BYTE_LEVEL, "word_bpe_49k.json": WORD_LEVEL}


def whole(name, texts, end):
    t = Tokenizer.from_file(public_path(name))
    return [np.array(x.ids + [end], "<u4") for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", MODELS)
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\t  ab'sStTrev0９Ééß.!😀\x1c\x85　​中́ΣΟς\x00ǅ\"LldDmİµŸ", max_size=40))
def test_chunks_give_the_library_ids(name, text):
    assert encoder(public_path(name), MODELS[name]).encode([text], 7)[0].tolist() == whole(name, [text], 7)[0].tolist()


@pytest.mark.parametrize("name", MODELS)
def test_strings_of_added_tokens_are_their_ids(name):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|> z", "plain Text", "<|endoftext"]
    got = [x.tolist() for x in encoder(public_path(name), MODELS[name]).encode(texts, 7)]
    assert got == [x.tolist() for x in whole(name, texts, 7)]
    assert {"byte_bpe_50k.json": 50256, "word_bpe_49k.json": 49407}[name] in got[0]


def test_a_full_cache_changes_nothing(monkeypatch):
    from lodestone.llm import tokens

    monkeypatch.setattr(tokens, "GENERATION", 3)
    e = tokens.ChunkEncoder(public_path("byte_bpe_50k.json"), BYTE_LEVEL)
    texts = ["a b c d e f", "a b g h", "", "x" * 100, "a b c"] * 3
    for _ in range(3):
        assert [x.tolist() for x in e.encode(texts, 2)] == [x.tolist() for x in whole("byte_bpe_50k.json", texts, 2)]


@pytest.mark.parametrize("name", sorted(MODELS))
def test_an_encoder_asks_once_for_what_many_texts_hold(name, monkeypatch):
    from lodestone.llm import tokens

    e = tokens.ChunkEncoder(public_path(name), MODELS[name])
    keys, asked = [], e._asked
    monkeypatch.setattr(e, "_asked", lambda new, single: keys.append(len(new)) or asked(new, single))
    texts = ["some plain words, and a few more.", "", " ", "x\x1fy \x01 z\x1f", "\x1f", "(odd) words  twice\n", "né ähnlich\xa0x", "中文 words", "w" * 300] * 40
    got = [x.tolist() for x in e.encode(texts, 7)]
    assert got == [x.tolist() for x in whole(name, texts, 7)]
    assert 0 < sum(keys) < 60  # runs and their chunks, not occurrences
    before = len(keys)
    short = [t for t in texts if len(t) < 300]
    assert [x.tolist() for x in e.encode(short, 7)] == [x.tolist() for x in whole(name, short, 7)]
    assert sum(keys[before:]) == 0


def test_between_tasks_an_encoder_keeps_one_bounded_generation(monkeypatch):
    from lodestone.llm import tokens

    monkeypatch.setattr(tokens, "GENERATION", 300)
    e = tokens.ChunkEncoder(public_path("byte_bpe_50k.json"), BYTE_LEVEL)
    texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}" for i in range(676)) for k in range(6)]
    for text in texts:
        assert e.encode([text], 2)[0].tolist() == whole("byte_bpe_50k.json", [text], 2)[0].tolist()
    assert e.old
    e.rest()
    assert not e.old and len(e.young) <= 300 + 676
    assert [x.tolist() for x in e.encode(texts, 2)] == [x.tolist() for x in whole("byte_bpe_50k.json", texts, 2)]


@pytest.mark.parametrize("name", MODELS)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "Né", "it's", ".", ",", ". ", ", ", " ", "  ", "\n", "\x01", "\x1c", "7", "!", "«", "中"]), max_size=14))
def test_texts_cut_at_spaces_and_stops_give_the_library_ids(name, parts):
    e, text = encoder(public_path(name), MODELS[name]), "".join(parts)
    assert e.encode([text], 7)[0].tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 7]


def test_cut():
    assert cut(1024) == [(0, 1024)] and cut(5) == [(0, 5)] and cut(2050) == [(0, 2), (2, 1024), (1026, 1024)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_plans_are_gapless_and_near_the_bound(counts):
    rows, bins = plan(counts, 64), {}
    for n, c in counts.items():
        mine = rows[rows[:, 0] == n]
        ends = np.append(mine[1:, 1], c)
        assert mine[0, 1] == 0 and (ends > mine[:, 1]).all()
        for (_, rank, first, offset), end in zip(mine.tolist(), ends.tolist()):
            for k in range(end - rank):
                bins.setdefault(first + k, []).append((offset, n))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64
    gaps = []  # best fit decreasing, one piece after another
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = min((g for g in gaps if g >= n), default=None)
        if at is not None:
            gaps.remove(at)
        gaps.append((64 if at is None else at) - n)
    assert len(bins) <= 1.15 * len(gaps) + 2


def test_pack(docs, rows):
    ids = {}
    for (i, _), x in zip(rows, whole("byte_bpe_50k.json", [t or "" for _, t in rows], 2)):
        ids.setdefault(i, []).append(x)
    got, bins = pack(docs).collect(), {}
    assert len(got) == sum(len(cut(len(x))) for xs in ids.values() for x in xs)
    for r in got:
        assert any(zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in ids[r.doc_id])
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024


def test_token_files(spark, docs, rows, tmp_path):
    ids = whole("word_bpe_49k.json", [t or "" for _, t in rows], 1)
    got = sorted(tokenize(docs).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(x), zlib.crc32(x)) for x in ids)
    path = str(tmp_path / "tokens")
    write_tokens(docs, path)
    some = read_tokens(spark, path, [9, 11])
    assert sorted(r.doc_id for r in some.collect()) == [9, 11]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    assert token_index(spark, path).count() == len(rows)


def test_empty_tables(empty):
    assert pack(empty).count() == tokenize(empty).count() == 0


@pytest.mark.parametrize("ranges", [1, 5])
def test_rounds_on_tables_equal_rounds_in_memory(spark, ranges):
    from lodestone.llm.packing import placed_runs

    rng = np.random.default_rng(4)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 100, 40), rng.integers(1, 30, 40))}
    table = spark.createDataFrame(list(counts.items()), "length long, n long")
    got = np.array(sorted((r.value, r.number, r.sequence, r.offset) for r in placed_runs(table, 100, ranges).collect()))
    wanted = plan(counts, 100)
    places = lambda rows: {(n, k, first + k - rank, offset) for (n, rank, first, offset), end in zip(rows.tolist(), ends(rows)) for k in range(rank, end)}
    ends = lambda rows: [int(b[1]) if b is not None and b[0] == a[0] else counts[int(a[0])] for a, b in zip(rows, [*rows[1:], None])]
    assert places(got) == places(wanted)
    assert placed_runs(table.limit(0), 100).count() == 0
