import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import numbered_snippet
from lodestone.operators import enrich, snippets
from lodestone.operators.ledger import Ledger


def counting(folder, fail_once=()):
    """A provider that leaves a file for each time a prompt is asked, and raises once on some, after earlier files are answered."""

    def ask(texts):
        for t in texts:
            for k in range(100):
                path = f"{folder}/{t}-{k}"
                if not os.path.exists(path):
                    open(path, "w").close()
                    break
            if t in fail_once and k == 0:
                raise TimeoutError
        return pd.Series([f"re {t}" for t in texts])

    return ask


def asked_times(folder):
    return sorted(os.listdir(folder))


def test_every_key_is_asked_once(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    provider = counting(tmp_path / "asked")
    rows = spark.createDataFrame([("a", "p1", 1), ("b", "p2", 2), ("a", "p1", 3)], "cache_key string, prompt string, x int")
    replies = enrich.answered(rows, provider)
    for _ in range(2):
        assert sorted((r.x, r.reply, r.cached) for r in replies.collect()) == [(1, "re p1", False), (2, "re p2", False), (3, "re p1", False)]
    assert asked_times(tmp_path / "asked") == ["p1-0", "p2-0"]
    book = Ledger(spark, str(tmp_path / "book"))
    first = enrich.answered(rows, provider, ledger=book)
    assert first.count() == 3 and first.filter("cached").count() == 0
    more = rows.unionByName(spark.createDataFrame([("c", "p3", 4), (None, "p4", 5)], rows.schema))
    again = enrich.answered(more, provider, ledger=Ledger(spark, str(tmp_path / "book")))
    assert sorted((r.x, r.cached) for r in again.collect()) == [(1, True), (2, True), (3, True), (4, False)] and again.count() == 4
    assert asked_times(tmp_path / "asked") == ["p1-0", "p1-1", "p2-0", "p2-1", "p3-0"]


def test_a_failed_job_loses_no_answer(spark, tmp_path, monkeypatch):
    from lodestone.operators import ledger

    monkeypatch.setattr(ledger, "KEYS_A_FILE", 2)
    (tmp_path / "asked").mkdir()
    rows = spark.createDataFrame([(f"k{i:02}", f"p{i:02}") for i in range(20)], "cache_key string, prompt string").coalesce(1)
    book = Ledger(spark, str(tmp_path / "book"))
    provider = counting(tmp_path / "asked", fail_once=("p07",))
    with pytest.raises(Exception, match="TimeoutError"):
        book.ask(rows, provider)
    before = book.replies().count()
    assert book.ask(rows, provider).count() == 20 - before
    assert {r.cache_key: r.reply for r in book.replies().collect()} == {f"k{i:02}": f"re p{i:02}" for i in range(20)}
    twice = [t for t in asked_times(tmp_path / "asked") if t.endswith("-1")]
    assert len(twice) <= 2 and not [t for t in asked_times(tmp_path / "asked") if t.endswith("-2")]  # only those of the call that failed
    assert book.ask(rows, lambda t: 1 / 0).count() == 0


def test_snippets_from_pieces_equal_those_from_whole_texts(spark):
    text = "\n".join(f"line {i}" for i in range(1, 501))
    files = spark.createDataFrame([("a", text), ("b", "one"), ("c", ""), ("d", text)], "path string, content string")
    rows = [("a", i) for i in (1, 2, 5, 63, 64, 65, 66, 128, 300, 499, 500)] + [("b", 1), ("c", 1)]
    found = spark.createDataFrame([(*r, "z") for r in rows] + [("a", 501, "z"), ("gone", 3, "z"), ("a", None, "z"), ("b", 9, "z")], "file_path string, line_number int, code string")
    got = {(r.file_path, r.line_number): r.code for r in snippets.with_snippets(found, files, 3).collect()}
    whole = found.join(files.withColumnRenamed("path", "file_path"), "file_path").filter("line_number <= size(split(content, '\\n', -1))")
    wanted = {(r.file_path, r.line_number): r.s for r in whole.select("file_path", "line_number", numbered_snippet(F.col("content"), F.col("line_number"), 3).alias("s")).collect()}
    assert {k: got[k] for k in wanted} == wanted and len(wanted) == len(rows)
    assert [got[k] for k in (("a", 501), ("gone", 3), ("a", None), ("b", 9))] == [""] * 4


def test_a_file_with_many_findings_moves_its_text_once(spark):
    text = "\n".join(f"line {i}" for i in range(1, 10_001))
    wanted = spark.range(10_000).select(F.lit("a").alias("file_path"), F.floor(F.col("id") / snippets.STRETCH).cast("int").alias("stretch"))
    cut = snippets.pieces(wanted, spark.createDataFrame([("a", text)], "path string, content string"), 10)
    moved = cut.agg(F.sum(F.length(F.array_join("lines", "\n")))).first()[0]
    assert moved < 1.4 * len(text)
