import random
import re
from collections import Counter

import pytest

from lodestone.llm.divergence import pieces, source_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, docs, groups = {}, {}, set()
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(lower))
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts.setdefault((lang, source), Counter()).update(terms)
        docs.setdefault(lang, Counter()).update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        q, p = shares(whole), {g[1]: shares(counts[g]) for g in groups if g[0] == lang}
        for source in p:
            pairs = [(o, sum(abs(p[source][t] - p[o][t]) for t in kept)) for o in p if o != source]
            terms = [(t, p[source][t] - q[t]) for t in kept if counts[lang, source][t] > 0 and p[source][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out.extend((lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked))
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, 7, "z") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, term string")


@pytest.mark.parametrize(("seed", "block"), [(1, 256), (2, 3)])
def test_divergence_equals_brute_force(spark, seed, block):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Éa", "É", "中文", "THE", "the", "it's"]
    rows = [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randint(0, 60))), rng.choice(["en", "fr", None, ""]), rng.choice(["hot"] * 9 + [f"s{i}" for i in range(11)] + [None, "é"])) for _ in range(400)]
    rows += [(None, "en", "s1"), (None, "xx", "only"), ("", "xx", "other"), ("123 __ 4", "en", "digits"), (rows[0][0] * 300, "en", "long")] + [rows[3]] * 5
    got = source_divergence(table(spark, rows).repartition(3), least_documents=8, top_terms=5, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 8, 5)


def test_counts_beyond_small_numbers_and_empty_tables(spark):
    rows = [("aa " * 5000 + "bb", "en", "s"), ("bb cc " * 3, "en", "t"), ("aa", "en", "t")]
    assert sorted(map(tuple, source_divergence(table(spark, rows), least_documents=1).collect())) == brute(rows, 1, 50)
    assert source_divergence(table(spark, [])).collect() == []


def test_pieces_end_between_terms():
    text = ("ab cd éé1" * 50).encode()
    cut = list(pieces(text, 16))
    assert b"".join(cut) == text and len(cut) > 10
    assert [t for p in cut for t in re.findall(rb"[a-z\x80-\xff]+", p)] == re.findall(rb"[a-z\x80-\xff]+", text)
    assert list(pieces(b"x" * 100, 16)) == [b"x" * 100]
