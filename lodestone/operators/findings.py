"""The findings relation: its columns, order, duplicates, filters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import SEVERITIES, basename, confidence_rank, severity_rank
from lodestone.operators.lineage import cut

#: Columns of findings with their types; the first four keep the order in which a scan finds them.
COLUMNS = {
    "engine_seq": "int", "rule_ord": "int", "pattern_idx": "int", "match_no": "int", "engine": "string", "rule_id": "string", "rule_name": "string",
    "description": "string", "severity": "string", "confidence": "string", "file_path": "string", "line_number": "int", "snippet": "string",
    "matched_pattern": "string", "cwe": "string", "owasp": "string", "remediation": "string", "references": "array<string>", "tags": "array<string>",
    "metadata": "map<string,string>",
}


def shaped(df: DataFrame, **values) -> DataFrame:
    """df with exactly the columns of findings: as they are, as given, else null."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    empty = {"references": F.array(), "tags": F.array(), "metadata": F.create_map()}
    return df.select(*[(given.get(c) if c in given else F.col(c) if c in df.columns else empty.get(c, F.lit(None))).cast(t).alias(c) for c, t in COLUMNS.items()])


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: The order in which a scan finds findings.
FOUND = _FOUND = ("engine_seq", "rule_ord", "pattern_idx", "match_no")


def deduplicated(findings: DataFrame) -> DataFrame:
    """The first finding of each rule, file and line, in the order of discovery.

    As a minimum of rows it is combined in each task before the shuffle, so a
    line that very many rules hit is no hot key.
    """
    rest = [c for c in findings.columns if c not in ("rule_id", "file_path", "line_number", "metadata")]
    order = [*_FOUND, *[c for c in rest if c not in _FOUND]]
    best = findings.groupBy("rule_id", "file_path", "line_number").agg(F.min(F.struct(*order, F.map_entries("metadata").alias("m"))).alias("b"))
    columns = {c: F.col(f"b.{c}") for c in rest} | {"metadata": F.map_from_entries("b.m")}
    return best.select(*[columns.get(c, F.col(c)).alias(c) for c in findings.columns])


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then by file and line."""
    return findings.orderBy(severity_rank(F.col("severity")).desc(), "file_path", "line_number", *_FOUND)


def at_least(findings: DataFrame, severity: str | None = None, confidence: str | None = None) -> DataFrame:
    if severity:
        findings = findings.filter(severity_rank(F.col("severity")) >= severity_rank(F.lit(severity)))
    if confidence:
        findings = findings.filter(confidence_rank(F.col("confidence")) >= confidence_rank(F.lit(confidence)))
    return findings


def summary(findings: DataFrame) -> DataFrame:
    """(severity, severity_rank, n): all five severities, with zeros."""
    levels = findings.sparkSession.createDataFrame(list(SEVERITIES.items()), "severity string, severity_rank int")
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("c"))
    return levels.join(counts, "severity", "left").select("severity", "severity_rank", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def affected_files(findings: DataFrame) -> DataFrame:
    return findings.select("file_path").distinct()


def top_categories(findings: DataFrame, n: int = 8) -> DataFrame:
    """The most frequent first parts of rule ids; ties in their order."""
    category = F.element_at(F.split("rule_id", "-"), 1)
    return findings.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(n)


def conditional_counts(findings: DataFrame, condition: Column) -> DataFrame:
    """(severity, total, matching)."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("total"), F.count_if(condition).alias("matching"))


def exit_code(findings: DataFrame, errors: int = 0) -> DataFrame:
    """One row: 2 for errors, 3 for a critical finding, 2 for a high one, 1 for any, else 0."""
    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    code = F.when(F.lit(errors > 0), 2).when(worst == 5, 3).when(worst == 4, 2).when(worst > 0, 1).otherwise(0)
    return findings.agg(code.cast("int").alias("exit_code"))


def numbered(findings: DataFrame) -> DataFrame:
    """finding_id F0001 and so on, in report order, without gathering all rows or all files in one task.

    Rows are sorted in ranges and written, each with its range and its place
    in it; the ranges' sizes, one row a range, are summed up and joined back.
    """
    rows = findings.withColumn("severity_rank", severity_rank(F.col("severity")))
    order = [F.col("severity_rank").desc(), F.col("file_path"), F.col("line_number"), *map(F.col, _FOUND)]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(sorted_rows.withColumn("part", F.spark_partition_id()).withColumn("k", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33) + 1))
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are ranges
    bases = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    out = placed.join(F.broadcast(bases), "part")
    return out.withColumn("finding_no", F.col("base") + F.col("k")).withColumn("finding_id", F.format_string("F%04d", F.col("finding_no"))).drop("k", "base", "part")


def in_files(findings: DataFrame, name: str) -> DataFrame:
    return findings.filter((F.col("file_path") == name) | (basename(F.col("file_path")) == name))
