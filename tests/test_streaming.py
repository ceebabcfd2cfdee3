from lodestone.plans.scan import Scan
from lodestone.sources import corpus, files, rules
from lodestone.streaming.incremental import scan_stream, windowed_metrics


def test_stream_of_files(spark, tmp_path):
    table = rules.from_rows(spark, corpus.RULES)
    rows = [(p, c) for p, c in corpus.FILES.items() if p.startswith("web/")]
    spark.createDataFrame(rows, "path string, content string").write.parquet(str(tmp_path / "in"))
    stream = files.from_table(spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in")))
    scan = Scan(engines=("rules",))
    scan_stream(stream, table, str(tmp_path / "out"), str(tmp_path / "state"), scan).awaitTermination()
    expected = scan.run(files.from_table(spark.createDataFrame(rows, "path string, content string")), table)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.rule_id, r.line_number) for r in got.collect()) == sorted((r.rule_id, r.line_number) for r in expected.collect()) != []


def test_windowed_metrics_of_a_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 2.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'a', 3.0D").write.parquet(str(tmp_path / "in"))
    stream = windowed_metrics(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("metrics").trigger(availableNow=True).start()
    query.awaitTermination()
    row = spark.table("metrics").first()
    assert (row.name, row.n, row.total) == ("a", 2, 5.0)
