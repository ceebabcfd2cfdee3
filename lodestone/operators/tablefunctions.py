"""Analyzers of one's own as table functions of SQL.

An analyzer that judges files alone becomes a function of a table of paths and
texts; one that judges a whole project gets its files partition by partition:

    SELECT * FROM todo_analyzer(TABLE(files))
    SELECT * FROM project_analyzer(TABLE(files) PARTITION BY project ORDER BY path)

Both are polymorphic: they name the columns that they read, pass over others,
say in ``analyze`` what they return, and refuse a table without what they need
before anything runs.  An analyzer that raises gives one row that says so in
``error`` and costs nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Columns of a table function's findings after those that it keeps of its input.
FOUND = (("rule_id", StringType()), ("line_number", IntegerType()), ("severity", StringType()), ("confidence", StringType()), ("snippet", StringType()), ("description", StringType()), ("error", StringType()))
FileAnalyzer = Callable[[str, str], Iterable[dict]]


class ProjectAnalyzer:
    """A whole project's analyzer: files one by one, in the order of the query, then what follows from all.

    Its state is what it keeps itself; it should not keep the texts.
    """

    def file(self, path: str, content: str) -> Iterable[dict]:
        return ()

    def finish(self) -> Iterable[dict]:
        return ()


def _result(argument: AnalyzeArgument, kept: tuple[str, ...]) -> AnalyzeResult:
    if not argument.isTable:
        raise ValueError("an analyzer reads a table: analyzer(TABLE(files))")
    there = {f.name.lower(): f for f in argument.dataType.fields}
    lacking = [c for c in ("path", "content", *kept) if c.lower() not in there]
    if lacking:
        raise ValueError(f"the table lacks {', '.join(lacking)}")
    own = [StructField(c, there[c.lower()].dataType) for c in kept]
    return AnalyzeResult(schema=StructType([*own, StructField("path", StringType()), *[StructField(n, t) for n, t in FOUND]]))


def _rows(found: Iterable[dict], path: str | None) -> Iterator[tuple]:
    defaults = {"severity": "medium", "confidence": "medium"}
    for x in found:
        yield x.get("path", path), *[x.get(n, defaults.get(n)) for n, _ in FOUND]


def _failed(path: str | None, error: Exception) -> tuple:
    return path, *[f"{type(error).__name__}: {error}" if n == "error" else None for n, _ in FOUND]


def _names(row: Row) -> dict[str, str]:
    return {c.lower(): c for c in row.__fields__}


def of_files(analyzer: FileAnalyzer, keep: tuple[str, ...] = ()):
    """A table function of a file analyzer; keep: columns of the table that its rows carry along."""

    class Function:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            return _result(table, keep)

        def eval(self, row: Row):
            of = _names(row)
            kept, path = [row[of[c.lower()]] for c in keep], row[of["path"]]
            try:
                found = list(_rows(analyzer(path, row[of["content"]] or ""), path))
            except Exception as e:  # one file's failure is its own row
                found = [_failed(path, e)]
            for x in found:
                yield *kept, *x

    return udtf(Function)


def of_projects(make: Callable[[], ProjectAnalyzer], keep: tuple[str, ...] = ()):
    """A table function of a project analyzer, made anew for each partition; keep: columns that are the same in all its rows."""

    class Function:
        def __init__(self) -> None:
            self.analyzer, self.kept, self.broken = make(), [None] * len(keep), False

        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            return _result(table, keep)

        def eval(self, row: Row):
            of = _names(row)
            self.kept, path = [row[of[c.lower()]] for c in keep], row[of["path"]]
            try:
                found = list(_rows(self.analyzer.file(path, row[of["content"]] or ""), path))
            except Exception as e:
                found = [_failed(path, e)]
            for x in found:
                yield *self.kept, *x

        def terminate(self):
            try:
                found = list(_rows(self.analyzer.finish(), None))
            except Exception as e:
                found = [_failed(None, e)]
            for x in found:
                yield *self.kept, *x

    return udtf(Function)


def register(spark: SparkSession, name: str, function) -> None:
    """Give a table function its name in SQL."""
    spark.udtf.register(name, function)


# --- two analyzers that any collection of texts can use


@dataclass
class Repeats(ProjectAnalyzer):
    """First lines that several files of a project share: state is a hash and a count for each distinct one."""

    seen: dict[int, list] = field(default_factory=dict)

    def file(self, path: str, content: str) -> Iterable[dict]:
        first = content.split("\n", 1)[0].strip()
        if first:
            self.seen.setdefault(hash(first), [path, first[:80], 0])[2] += 1
        return ()

    def finish(self) -> Iterable[dict]:
        for path, first, n in self.seen.values():
            if n > 1:
                yield {"path": path, "rule_id": "REPEATED-HEAD", "line_number": 1, "severity": "info", "snippet": first, "description": f"{n} files begin alike"}


def long_lines(path: str, content: str, most: int = 400) -> Iterator[dict]:
    """Lines of more than so many characters."""
    for number, line in enumerate(content.split("\n"), 1):
        if len(line) > most:
            yield {"rule_id": "LONG-LINE", "line_number": number, "severity": "low", "snippet": line[:40], "description": f"{len(line)} characters"}
