"""Scans of files as they arrive, and windowed metrics of scan events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.scan import Scan


def scan_stream(files: DataFrame, rules: DataFrame, out: str, checkpoint: str, scan: Scan | None = None) -> StreamingQuery:
    """Scan each micro-batch of a stream of files and append its findings.

    What a scan reads of a whole project (which frameworks are there, whether
    it is a Spring application, rules across files, taint along calls) it
    reads of the files of its batch only, so findings of these kinds depend on
    how files arrive; rules and check tables do not.  Scan the whole tree for
    them, from time to time.

    A batch's folder is replaced when the batch runs again after a failure, so
    every file's findings are written once.
    """
    scan = scan or Scan()

    def batch(part: DataFrame, epoch: int) -> None:
        scan.run(part, rules).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_findings(findings: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """A stream of findings without those already seen within the watermark."""
    return findings.withWatermark(time, late).dropDuplicatesWithinWatermark(["rule_id", "file_path", "line_number"])


def windowed_metrics(events: DataFrame, time: str = "ts", name: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """count, total, least and greatest value of each name and time window; on a stream, with a watermark."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    grouped = rows.groupBy(F.window(time, width).alias("w"), F.col(name).alias("name"))
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("window_start"), "name", "n", "total", "least", "most")
