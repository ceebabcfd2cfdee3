import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import queries
from lodestone.llm.exact_dedup import normal_form
from lodestone.llm.simhash import fingerprint

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    wanted = connection.sql(queries.oracle_sql()[name])
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, wanted.select(*columns).fetchall()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, DATA).cache()
        assert after.columns == columns and 0 < after.count() <= before.count()
        assert after.exceptAll(before).isEmpty()
        if name == "exact dedup":
            assert after.select(normal_form("text").alias("n")).distinct().count() == after.count()
        if name == "near dedup":
            prints = [fingerprint(r.text.encode()) for r in after.collect()]
            assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[i + 1 :])
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, DATA)
    assert pieces.select("doc_id").distinct().count() == before.count()


def brute_pipeline(rows, accepted, items):
    """Ids that stay of (doc_id, text) rows, by plain loops over the same rules."""
    from lodestone.llm.winnow import words_of
    from test_models import brute

    left = [(i, t) for i, t in rows if (i, t) in accepted]
    groups = {}
    for i, t in left:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i, t))
    left = [min(g, key=lambda y: y[:3])[3:] for g in groups.values()]

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}

    sets, parent = [shingles(t) for _, t in left], list(range(len(left)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(left)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 9 * common >= 4 * (len(sets[a]) + len(sets[b])):
                parent[find(a)] = find(b)
    parts = {}
    for k, row in enumerate(left):
        parts.setdefault(find(k), []).append(row)
    left = [min(p, key=lambda r: (r[0] is None, r[0] or 0)) for p in parts.values()]
    hit = [n > 0 for _, _, n, _ in brute(left, items)]
    assert words_of(b"") == []
    return sorted((i for (i, _), h in zip(left, hit) if not h), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    from lodestone.llm.quality_qda import quality_scores
    from lodestone.llm.tokens import public_path

    given = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in given.collect()]
    long = max((t for _, t in rows), key=len)
    rows += [(9001, None), (9002, ""), (None, rows[0][1]), (9003, rows[3][1] + "\n"), (9004, rows[3][1]), rows[5], (9005, long + " one more"), (9006, None), (9007, " \t")]
    table = spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], given.schema).repartition(3)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    scored = quality_scores(table, spark.read.parquet(f"{DATA}/labels.parquet")).filter("predicted = 1").select("doc_id", "__content").distinct()
    accepted = {(r.doc_id, r.text) for r in table.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS __content").join(scored.withColumnsRenamed({"doc_id": "i", "__content": "c"}), F.expr("doc_id <=> i AND __content = c")).collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    wanted = brute_pipeline(rows, accepted, items)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in out}, key=str) == wanted and 50 < len(wanted) < len(rows)
    encode, texts = Tokenizer.from_file(public_path("byte_bpe_50k.json")).encode, dict(rows)
    totals = {}
    for r in out:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.length
    assert totals == {i: len(encode(texts[i] or "", add_special_tokens=False).ids) + 1 for i in wanted}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
