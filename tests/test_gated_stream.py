import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import corpus, files, rules
from lodestone.streaming import gated

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.mark.parametrize("seed", [2])
def test_any_split_into_batches_gives_one_scan(spark, tmp_path, seed):
    both = {**corpus.FILES, **corpus.CODE}
    rows = [("p", p, c) for p, c in both.items()] + [("other", p, c) for p, c in both.items() if not p.endswith((".json", "manage.py", "settings.py"))]
    rng = random.Random(seed)
    rng.shuffle(rows)
    rows += rng.sample(rows, 5)  # some files come again
    schema = "project string, path string, content string"
    n = 4
    for k in range(n):
        spark.createDataFrame(rows[k * len(rows) // n : (k + 1) * len(rows) // n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = rules.from_rows(spark, corpus.RULES)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def tree(df):
        made = files.from_table(df)
        return made

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = source.withColumn("joined", F.concat_ws("\x01", "project", "path"))
    stream = files.from_table(stream, "joined").withColumn("project", F.substring_index("path", "\x01", 1)).withColumn("path", F.substring_index("path", "\x01", -1))
    query = gated.scanned(stream, table).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == n
    got = sorted((r.project, r.rule_id, r.file_path, r.line_number, r.engine) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    wanted = []
    for project in ("p", "other"):
        df = tree(spark.createDataFrame(sorted({r for r in rows if r[0] == project}), schema))
        wanted += [(project, r.rule_id, r.file_path, r.line_number, r.engine) for r in gated.once(df, table).collect()]
    assert got == sorted(wanted) and any(w[4].startswith("framework:") for w in wanted)
