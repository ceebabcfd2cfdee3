"""The lines around findings, cut out of each file once.

Findings of one stretch of a file share its lines: the file's text meets the
list of its stretches that are wanted, is split and cut there, and what is
joined to findings are pieces of some lines.  A file with very many findings
moves its text once, and its findings are dealt over its stretches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import numbered_lines

#: Lines of a stretch, without those around it.
STRETCH = 64


def pieces(wanted: DataFrame, files: DataFrame, around: int, stretch: int = STRETCH) -> DataFrame:
    """(file_path, stretch, at, lines): for each distinct (file_path, stretch), its lines and those around it, from line ``at`` on."""
    lists = wanted.select("file_path", "stretch").distinct().groupBy("file_path").agg(F.collect_set("stretch").alias("stretches"))  # a file's length bounds them
    cut = files.select(F.col("path").alias("file_path"), "content").join(lists, "file_path").select("file_path", F.split("content", "\n", -1).alias("all"), F.explode("stretches").alias("stretch"))
    at = F.greatest(F.col("stretch") * stretch + 1 - around, F.lit(1))
    return cut.select("file_path", "stretch", at.alias("at"), F.slice("all", at, (F.col("stretch") + 1) * stretch + around + 1 - at).alias("lines"))


def with_snippets(findings: DataFrame, files: DataFrame, around: int, column: str = "code", stretch: int = STRETCH) -> DataFrame:
    """findings (file_path, line_number and more) with their numbered lines; empty where the file or the line is not there."""
    rows = findings.drop(column).withColumn("__stretch", F.floor((F.col("line_number") - 1) / stretch).cast("int"))
    wanted = rows.filter("line_number > 0").select("file_path", F.col("__stretch").alias("stretch"))
    found = pieces(wanted, files, around, stretch).withColumnsRenamed({"stretch": "__stretch", "at": "__at", "lines": "__lines"})
    joined = rows.join(found, ["file_path", "__stretch"], "left")
    inside = (F.col("line_number") >= F.col("__at")) & (F.col("line_number") < F.col("__at") + F.size("__lines"))
    text = F.coalesce(F.when(inside, numbered_lines(F.col("__lines"), F.col("__at"), F.col("line_number"), around)), F.lit(""))
    return joined.select(*[F.col(f"`{c}`") for c in findings.columns if c != column], text.alias(column))
