"""Paid answers, each asked for once: an append-only ledger of keys and replies.

Questions become distinct keys, those that the ledger has drop out, and the
rest are written down before anyone is asked, so that a task that runs again
gets the same questions in the same order.  A task asks a few keys at a time
and puts their answers into the ledger at once, by renaming a finished file;
when it runs again after a failure, what it finds there is not asked again.
Only when all are answered do readers join them, from the ledger, so counting
or reporting twice asks nobody.

A few keys can be asked twice only if an executor dies between an answer and
its renaming, or if the same task runs twice at once: switch speculative
execution off for jobs that pay for answers.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.lineage import cut

SCHEMA = "cache_key string, reply string, latency_ms double"
_ARROW = pa.schema([("cache_key", pa.string()), ("reply", pa.string()), ("latency_ms", pa.float64())])
#: Keys that are asked before their answers are put down.
KEYS_A_FILE = 16


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path


class Ledger:
    """Answers in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, _uri(path.rstrip("/"))
        files, folder = pafs.FileSystem.from_uri(self.path)
        files.create_dir(folder, recursive=True)

    def replies(self) -> DataFrame:
        """(cache_key, reply, latency_ms): one answer for each key."""
        rows = self.spark.read.schema(SCHEMA).option("pathGlobFilter", "answers-*").parquet(self.path)
        return rows.groupBy("cache_key").agg(F.min(F.struct("reply", "latency_ms")).alias("a")).select("cache_key", "a.reply", "a.latency_ms")

    def ask(self, questions: DataFrame, provider: Callable[[pd.Series], pd.Series]) -> DataFrame:
        """Have everything of (cache_key, prompt) answered that is not yet; returns the keys that were new.

        Rows with a null key are not asked; of several prompts of one key the least counts.
        """
        distinct = questions.filter("cache_key IS NOT NULL").groupBy("cache_key").agg(F.min("prompt").alias("prompt"))
        todo = cut(distinct.join(self.replies().select("cache_key"), "cache_key", "left_anti"))
        path = self.path

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, folder = pafs.FileSystem.from_uri(path)
            for batch in batches:
                for at in range(0, len(batch), KEYS_A_FILE):
                    some = batch.iloc[at : at + KEYS_A_FILE]
                    _answer(files, folder, some, provider)
                yield pd.DataFrame({"n": [len(batch)]})

        todo.mapInPandas(run, "n long").agg(F.sum("n")).collect()
        return todo.select("cache_key")


def _answer(files: pafs.FileSystem, folder: str, some: pd.DataFrame, provider: Callable[[pd.Series], pd.Series]) -> None:
    """Answers of a few keys, put into the ledger under a name that the keys give; nothing if they are there."""
    name = hashlib.sha256("\n".join(some["cache_key"]).encode()).hexdigest()
    target = f"{folder}/answers-{name}.parquet"
    if files.get_file_info(target).type == pafs.FileType.File:
        return
    begun = time.perf_counter()
    replies = list(provider(some["prompt"].reset_index(drop=True)))
    if len(replies) != len(some):
        raise ValueError(f"{len(some)} prompts, {len(replies)} replies")
    latency = 1000 * (time.perf_counter() - begun) / len(some)
    unfinished = f"{folder}/_unfinished-{uuid.uuid4().hex}"
    with files.open_output_stream(unfinished) as out:
        pq.write_table(pa.table([pa.array(some["cache_key"], pa.string()), pa.array(replies, pa.string()), pa.array([latency] * len(some))], schema=_ARROW), out)
    files.move(unfinished, target)
