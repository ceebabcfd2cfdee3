"""Cutting the lineage of tables that several steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that this process has written.
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the driver and all executors share; one of our own only in local mode without the setting."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if given:
        return given.rstrip("/")
    return "file://" + tempfile.gettempdir().rstrip("/") + "/lodestone-checkpoints" if spark.sparkContext.master.startswith("local") else None


def shuffled(df: DataFrame) -> DataFrame:
    """df whose next join shuffles both sides: a side that is broadcast goes through the driver, in every round of a walk anew."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """df computed once: a table written to the shared folder and read again, or cached where the session names none.

    Joins with it shuffle, unless the other side is hinted to be broadcast.

    Unlike a checkpoint, a table that is read again brings along nothing of the
    plan that made it: what the optimizer has inferred there would grow with
    every round of a loop.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        return shuffled(df.cache())
    path = f"{folder}/lodestone/cut-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return shuffled(spark.read.schema(df.schema).parquet(path))


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that cut() has written in this process: for callers that have used or stored their results."""
    while _written:
        target = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
