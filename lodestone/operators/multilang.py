"""Sources, sinks and sanitizers of tainted values in seven languages, and joins with them."""

from __future__ import annotations

import csv
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One entry a line: language, part, method and kind.
TABLE = Path(__file__).with_suffix(".csv")
ALIASES = {"cs": "csharp", "kt": "kotlin", "rb": "ruby", "rs": "rust"}


@cache
def _entries() -> dict[str, dict[str, dict[str, str]]]:
    """Language to part to method to kind, as the file has them."""
    out: dict[str, dict[str, dict[str, str]]] = {}
    with TABLE.open(newline="") as file:
        for row in csv.DictReader(line for line in file if not line.startswith("#")):
            out.setdefault(row["language"], {}).setdefault(row["part"], {})[row["method"]] = row["kind"]
    return out


def languages() -> list[str]:
    return list(_entries())


def language_of(name: str) -> str | None:
    """The language of a name or alias, in any case."""
    name = ALIASES.get(name.lower(), name.lower())
    return name if name in _entries() else None


def _of(part: str, language: str) -> dict[str, str]:
    """Method to what it gives, reaches or cleans for."""
    return dict(_entries().get(language_of(language), {}).get(part, {}))


def sources(language: str) -> dict[str, str]:
    return _of("source", language)


def sinks(language: str) -> dict[str, str]:
    return _of("sink", language)


def annotations(language: str) -> dict[str, str]:
    return _of("annotation", language)


def sanitizers(language: str) -> dict[str, frozenset[str]]:
    """Method to the sinks that it cleans for."""
    return {m: frozenset(kinds.split()) for m, kinds in _of("sanitizer", language).items()}


def cleans(language: str, method: str, sink: str) -> bool:
    return sink in sanitizers(language).get(method, ())


def table(spark: SparkSession) -> DataFrame:
    """(language, method, source, sink, cleans, annotation): one row per language and method, for joins."""
    rows = []
    for language in languages():
        given, reached, cleaned, marked = sources(language), sinks(language), sanitizers(language), annotations(language)
        for method in sorted({*given, *reached, *cleaned, *marked}):
            rows.append((language, method, given.get(method), reached.get(method), sorted(cleaned.get(method, ())), marked.get(method)))
    return spark.createDataFrame(rows, "language string, method string, source string, sink string, cleans array<string>, annotation string")


def looked_up(calls: DataFrame) -> DataFrame:
    """calls (with language and method) and what the tables say of them; null and an empty list where they say nothing."""
    alias = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    keyed = calls.withColumn("__language", F.coalesce(alias[F.lower("language")], F.lower("language")))
    known = table(calls.sparkSession).withColumnsRenamed({"language": "__language", "method": "__method"})
    joined = keyed.join(F.broadcast(known), (keyed["__language"] == known["__language"]) & (keyed["method"] == known["__method"]), "left")  # some hundred rows
    return joined.select(*[keyed[c] for c in calls.columns], "source", "sink", F.coalesce("cleans", F.array().cast("array<string>")).alias("cleans"), "annotation")
