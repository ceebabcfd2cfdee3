"""One ordered text file of rows that executors write: a data source writer with a commit message for each task.

Each task writes its rows as a part beside the target, under a name of its own,
and reports it; the commit joins the reported parts in order, between a head
and a foot, and puts the whole in place at once.  What failed or repeated
tasks wrote is reported by nobody and goes with the folder of parts, so no row
is there twice, and no row passes through the driver.  The target's folder has
to be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_COPY = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its place in the order, its file (None without rows), and its rows."""

    place: int
    file: str | None
    rows: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, separator: str, foot: str, overwrite: bool) -> None:
        self.path, self.head, self.separator, self.foot, self.overwrite = path, head, separator, foot, overwrite
        self.parts = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """Runs in a task: rows of one text column, between them the separator."""
        place, rows, file = TaskContext.get().partitionId(), 0, None
        name = os.path.join(self.parts, f"{place:010}-{uuid.uuid4().hex}")
        try:
            for batch in iterator:
                for value in batch.column(0).to_pylist():
                    if file is None:
                        os.makedirs(self.parts, exist_ok=True)
                        file = open(name, "w", encoding="utf-8")
                    if rows:
                        file.write(self.separator)
                    file.write(value or "")
                    rows += 1
        finally:
            if file is not None:
                file.close()
        return Part(place, name if rows else None, rows)

    def commit(self, messages: list[Part | None]) -> None:
        """Join the parts that the tasks which counted have reported."""
        if not self.overwrite and os.path.exists(self.path):
            self.abort(messages)
            raise FileExistsError(self.path)
        whole = f"{self.parts}.whole"
        with open(whole, "wb") as out:
            out.write(self.head.encode())
            first = True
            for part in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.place):
                if not first:
                    out.write(self.separator.encode())
                first = False
                with open(part.file, "rb") as file:
                    shutil.copyfileobj(file, out, _COPY)
            out.write(self.foot.encode())
        os.replace(whole, self.path)
        shutil.rmtree(self.parts, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.parts, ignore_errors=True)


class DocumentSource(DataSource):
    """``df.write.format("ordered_document")``: options path, head, separator and foot (JSON strings)."""

    @classmethod
    def name(cls) -> str:
        return "ordered_document"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        head, separator, foot = json.loads(self.options["texts"])
        return DocumentWriter(self.options["path"], head, separator, foot, overwrite)


def write(rows: DataFrame, path: str, head: str = "", separator: str = "\n", foot: str = "", mode: str = "overwrite") -> None:
    """Write a table of one text column, in its order, as one file; no rows give head and foot alone."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    rows.select(rows[rows.columns[0]].cast("string").alias("value")).write.format(DocumentSource.name()).mode(mode).option("texts", json.dumps([head, separator, foot])).save(os.path.abspath(path))
