"""A scan: files and rules in, one findings relation out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import any_of
from lodestone.operators import findings as relation
from lodestone.operators import astcheck, deepflow, mybatis, onepass, spring, taint
from lodestone.operators.context import TEST_PATHS, VENDOR_PATHS, with_context
from lodestone.operators.lineage import cut
from lodestone.sources.rules import chosen


def dataflow(files: DataFrame) -> DataFrame:
    """Taint within methods; only where that finds nothing at all, taint by lines and along the call graph."""
    deep = cut(deepflow.findings(files))
    return taint.findings(files) if deep.isEmpty() else deep


@dataclass(frozen=True)
class Scan:
    """Options of a scan.  The engines' findings are one union, ordered, deduplicated and freed of doubtful ones."""

    languages: list[str] | None = None
    tags: list[str] | None = None
    severity_min: str | None = None
    skip_tests: bool = False
    skip_vendor: bool = True
    context_aware: bool = True
    engines: tuple[str, ...] = field(default=("rules", "ast", "dataflow", "spring", "mybatis", "frameworks", "languages", "iac"))

    def raw(self, files: DataFrame, rules: DataFrame) -> DataFrame:
        """Every engine's findings, before context and duplicates; rules pass over vendored and, on demand, test files."""
        wanted = chosen(rules, self.languages, self.tags, self.severity_min)
        left_out = (any_of(F.col("path"), VENDOR_PATHS) & F.lit(self.skip_vendor)) | (any_of(F.col("path"), TEST_PATHS) & F.lit(self.skip_tests))
        marked = files.withColumn("plain", ~left_out)
        parts = [onepass.scan(marked, wanted, self.engines, self.context_aware)]
        for name, found in (("ast", astcheck.java_findings), ("dataflow", dataflow), ("spring", spring.project_findings), ("mybatis", mybatis.findings), ("languages", astcheck.go_findings)):
            if name in self.engines:
                parts.append(found(files))
        return relation.union_all(*parts)

    def run(self, files: DataFrame, rules: DataFrame) -> DataFrame:
        found = self.raw(files, rules)
        if self.context_aware:
            found = with_context(found, files)
        return relation.deduplicated(found)


def scan_info(files: DataFrame, rules: DataFrame, target: str) -> DataFrame:
    """One row about a scan."""
    return files.agg(F.count(F.lit(1)).alias("files_scanned")).crossJoin(rules.agg(F.count_if("enabled").alias("rules_applied"))).withColumn("target_path", F.lit(target))  # one row each
