"""Analyzers of one's own beside the built-in ones.

An analyzer is a function of a path and a text that yields findings as
dictionaries.  It runs in the vectorised pass over the files it is for; what
it raises costs its file's rows and nothing else.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.check_tables import FRAMEWORKS, LANGUAGES
from lodestone.operators.findings import COLUMNS, shaped

Analyzer = Callable[[str, str], Iterable[dict]]
KINDS = ("language", "framework", "iac")
_ROW = [c for c in COLUMNS if c != "metadata"]


class Registry:
    """Analyzers by kind and by extension or framework."""

    def __init__(self) -> None:
        self._of: dict[str, dict[str, Analyzer]] = {k: {} for k in KINDS}

    def _adder(self, kind: str, names: tuple[str, ...]) -> Callable[[Analyzer], Analyzer]:
        def add(analyzer: Analyzer) -> Analyzer:
            self._of[kind].update({n.lower(): analyzer for n in names})
            return analyzer

        return add

    def language(self, *extensions: str) -> Callable[[Analyzer], Analyzer]:
        """A decorator for an analyzer of files with an extension."""
        return self._adder("language", extensions)

    def framework(self, name: str) -> Callable[[Analyzer], Analyzer]:
        """A decorator for an analyzer of all files where a framework is present."""
        return self._adder("framework", (name,))

    def iac(self, *extensions: str) -> Callable[[Analyzer], Analyzer]:
        """A decorator for an analyzer of infrastructure files: by extension, or ``dockerfile`` for files of that name."""
        return self._adder("iac", extensions)

    def clear(self) -> None:
        for of in self._of.values():
            of.clear()

    def extensions(self) -> set[str]:
        return {*self._of["language"], *self._of["iac"]}

    def stats(self) -> dict[str, int]:
        """Distinct analyzers by kind, and the extensions they are for."""
        return {f"{k}_analyzers": len(set(self._of[k].values())) for k in KINDS} | {"supported_extensions": len(self.extensions())}

    def run(self, files: DataFrame, present: Iterable[str] = ()) -> DataFrame:
        """Findings of all analyzers; present: the frameworks of the project."""
        of, frameworks = {k: dict(v) for k, v in self._of.items()}, [f.lower() for f in present]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = []
                for path, name, ext, content in batch.itertuples(index=False, name=None):
                    chosen = [("language", of["language"].get(ext)), *(("framework", of["framework"].get(f)) for f in frameworks)]
                    chosen.append(("iac", of["iac"].get(ext) or (of["iac"].get("dockerfile") if name.lower().startswith("dockerfile") else None)))
                    for kind, analyzer in chosen:
                        if analyzer:
                            rows.extend(_rows(kind, analyzer, path, content or ""))
                yield pd.DataFrame(rows, columns=_ROW)

        schema = ", ".join(f"`{c}` {COLUMNS[c]}" for c in _ROW)
        return shaped(files.select("path", "name", "ext", "content").mapInPandas(run, schema))


def _rows(kind: str, analyzer: Analyzer, path: str, content: str) -> list[tuple]:
    """An analyzer's findings of a file; none if it raises."""
    try:
        found = list(analyzer(path, content))
    except Exception:
        logging.getLogger(__name__).exception("analyzer failed on %s", path)
        return []
    fixed = {"engine": f"custom:{kind}", "engine_seq": 80 + KINDS.index(kind), "rule_ord": 0, "pattern_idx": 0, "file_path": path, "severity": "medium", "confidence": "medium"}
    empty = {"references": [], "tags": []}
    return [tuple(({"match_no": n} | fixed | x).get(c, empty.get(c)) for c in _ROW) for n, x in enumerate(found, 1)]


def built_in() -> dict[str, int]:
    """How many languages, frameworks with checks and extensions the built-in tables are for."""
    return {"languages": len(LANGUAGES), "frameworks": sum(1 for _, t in FRAMEWORKS.values() if t), "extensions": len({e for x, _ in LANGUAGES.values() for e in x})}


def timed_counts(metrics: DataFrame) -> DataFrame:
    """(name, n, total, least, most, mean) of (name, seconds), the longest in total first."""
    s = F.col("seconds")
    return metrics.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("total"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg(s).alias("mean")).orderBy(F.desc("total"), "name")
