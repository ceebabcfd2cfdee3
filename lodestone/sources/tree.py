"""A folder tree as a data source: pruned while it is listed, dealt out by bytes, read in parallel.

Spark's own file sources pass over every name that begins with ``_`` or ``.``
and list folders before any filter.  This one lists what a scan reads, never
enters a folder that it passes over, and takes filters on path, name, ext and
size before a file is opened.  The folder has to be where all executors see it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from fnmatch import translate
from functools import cache
import json
import re

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, name string, ext string, size long, content binary"
#: Bytes, and files, that make a partition.
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 2000
#: Bytes of an Arrow batch of contents, a large file more.
BATCH_BYTES = 8 << 20


@cache
def _glob(pattern: str) -> re.Pattern:
    return re.compile(translate(f"*{pattern}*"))


def passed_over(path: str, pattern: str) -> bool:
    """``dir/`` is a folder of the path, a glob matches anywhere in it, anything else is a part of it."""
    if pattern.endswith("/"):
        return "/" + pattern in path or path.startswith(pattern)
    if "*" in pattern or "?" in pattern:
        return _glob(pattern).match(path) is not None
    return pattern in path


def suffix_of(name: str) -> str:
    """The last suffix in lower case; a name that only begins with a dot has none."""
    return os.path.splitext(name)[1].lower()


_COMPARE = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


class Files(InputPartition):
    """Paths and sizes of the files of one partition."""

    def __init__(self, files: list[tuple[str, int]]) -> None:
        super().__init__(0)
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, root: str, options: dict) -> None:
        self.root = root
        self.skip_directories, self.skip_names = set(options["skip_directories"]), set(options["skip_names"])
        self.extensions, self.names, self.excludes = set(options["extensions"]), set(options["names"]), options["excludes"]
        self.max_bytes = options["max_bytes"]
        self.filters: list[tuple[str, str, object]] = []
        self.listed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in _COMPARE and len(column) == 1 and column[0] in ("path", "name", "ext", "size"):
                self.filters.append((column[0], type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, path: str, name: str, size: int) -> bool:
        ext = suffix_of(name)
        if name in self.skip_names or (ext not in self.extensions and name not in self.names) or size > self.max_bytes:
            return False
        values = {"path": path, "name": name, "ext": ext, "size": size}
        kinds = {k.__name__: v for k, v in _COMPARE.items()}
        return all(kinds[kind](values[c], v) for c, kind, v in self.filters) and not any(passed_over(path, p) for p in self.excludes)

    def walk(self) -> Iterator[tuple[str, int]]:
        """Path and size of each file that is wanted, folder by folder in order; self.listed gets the folders."""
        if os.path.isfile(self.root):
            size = os.path.getsize(self.root)
            if self._wanted(self.root, os.path.basename(self.root), size):
                yield self.root, size
            return
        folders = [self.root]
        while folders:
            folder = folders.pop()
            self.listed.append(folder)
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError:
                continue  # gone, or not ours to read
            below = []
            for entry in entries:
                try:
                    if entry.is_dir(follow_symlinks=False):
                        if entry.name not in self.skip_directories:
                            below.append(entry.path)
                    elif entry.is_file() and self._wanted(entry.path, entry.name, size := entry.stat().st_size):
                        yield entry.path, size
                except OSError:
                    continue
            folders.extend(reversed(below))

    def partitions(self) -> list[Files]:
        out, now, total = [], [], 0
        for path, size in self.walk():
            if now and (total + size > PARTITION_BYTES or len(now) == PARTITION_FILES):
                out.append(Files(now))
                now, total = [], 0
            now.append((path, size))
            total += size
        return out + [Files(now)] if now or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path, bytes_ in partition.files:
            try:
                with open(path, "rb") as file:
                    content = file.read()
            except OSError:
                content = None
            name = os.path.basename(path)
            held.append((path, name, suffix_of(name), bytes_, content))
            size += len(content or b"")
            if size >= BATCH_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    path, name, ext, size, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"path": path, "name": name, "ext": ext, "size": pa.array(size, pa.int64()), "content": pa.array(content, pa.binary())})


class TreeSource(DataSource):
    """``spark.read.format("source_tree").option("settings", json).load(folder)``: a row per file, its content null if it cannot be read."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], json.loads(self.options["settings"]))


def read(spark: SparkSession, root: str, settings: dict):
    """The tree's rows; settings: skip_directories, skip_names, extensions, names, excludes and max_bytes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).option("settings", json.dumps(settings)).load(root)
