"""Detection rules: YAML documents and plain rows, as a table of patterns."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.regex import glob, java
from lodestone.functions.text import CONFIDENCES, SEVERITIES, severity_rank

PATTERN = "struct<pattern:string,language:string,description:string,context:string,missing:string,case_insensitive:boolean>"
SCHEMA = (
    "rule_ord int, rule_id string, rule_name string, description string, severity string, confidence string, cwe string, owasp string, cve string, tags array<string>, "
    f"languages array<string>, file_patterns array<string>, patterns array<{PATTERN}>, remediation string, code_examples map<string,string>, references array<string>, enabled boolean"
)

# File suffixes of the languages that a rule can name.
RULE_SUFFIXES = {
    "java": [".java"], "python": [".py"], "javascript": [".js", ".jsx", ".ts", ".tsx"], "php": [".php"], "csharp": [".cs"], "go": [".go"],
    "ruby": [".rb"], "xml": [".xml"], "yaml": [".yml", ".yaml"], "properties": [".properties"], "html": [".html", ".htm"],
}
# Kinds of vulnerability by a part of a rule's id or tags; the first that fits counts.
KINDS = (
    ("sqli", "sql_injection"), ("sql", "sql_injection"), ("cmdi", "command_injection"), ("cmd", "command_injection"), ("command", "command_injection"),
    ("xss", "xss"), ("cross-site", "xss"), ("path", "path_traversal"), ("traversal", "path_traversal"), ("lfi", "path_traversal"),
)


def _strings(value) -> list[str]:
    return [str(x) for x in value] if isinstance(value, list) else [str(value)] if value else []


def parsed(document: dict, category: str | None = None) -> tuple | None:
    """A rule's row from its YAML; None if it has no id or no name."""
    if not isinstance(document, dict) or not document.get("id") or not document.get("name"):
        return None
    level = lambda key, known: v if (v := str(document.get(key, "medium")).lower()) in known else "medium"
    optional = lambda key: str(document[key]) if document.get(key) else None
    patterns = []
    for p in (document.get("detection") or {}).get("patterns") or []:
        p = {"pattern": p} if isinstance(p, str) else p
        if isinstance(p, dict) and p.get("pattern"):
            text = lambda key: str(p[key]) if p.get(key) else None  # noqa: B023, E731
            patterns.append((str(p["pattern"]), text("language"), text("description"), text("context"), text("missing"), bool(p.get("case_insensitive", False))))
    fix = document.get("remediation") or {}
    fix = {"description": fix} if isinstance(fix, str) else fix
    code = fix.get("code_example") or {}
    examples = {"default": code} if isinstance(code, str) else {str(k): str(v) for k, v in code.items()}
    return (
        0, str(document["id"]), str(document["name"]), str(document.get("description") or ""), level("severity", SEVERITIES), level("confidence", CONFIDENCES), optional("cwe"),
        optional("owasp") or category, optional("cve"), _strings(document.get("tags")), _strings(document.get("languages")), _strings(document.get("file_patterns")), patterns,
        fix.get("description"), examples, _strings(document.get("references")), bool(document.get("enabled", True)),
    )


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """The rules table of rule documents, in order."""
    found = [r for r in map(parsed, rows) if r]
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(found)], SCHEMA)


def from_yaml(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of all YAML files below a folder; a file that can't be read is passed over."""
    import yaml

    rows = []
    for path in [*sorted(Path(folder).rglob("*.yaml")), *sorted(Path(folder).rglob("*.yml"))]:
        try:
            document = yaml.safe_load(path.read_text(encoding="utf-8"))
        except (yaml.YAMLError, UnicodeDecodeError):
            continue
        if isinstance(document, dict):
            category = (document.get("metadata") or {}).get("category")
            rows += [r for r in (parsed(d, category) for d in document.get("rules") or []) if r]
    return spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)


def chosen(rules: DataFrame, languages: list[str] | None = None, tags: list[str] | None = None, severity_min: str | None = None) -> DataFrame:
    """Enabled rules that meet a scan's filters; rules without languages meet any language filter."""
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    out = rules.filter("enabled")
    if languages:
        out = out.filter((F.size("languages") == 0) | F.arrays_overlap(lower("languages"), F.array(*[F.lit(x.lower()) for x in languages])))
    if tags:
        out = out.filter(F.arrays_overlap(lower("tags"), F.array(*[F.lit(x.lower()) for x in tags])))
    if severity_min:
        out = out.filter(severity_rank(F.col("severity")) >= SEVERITIES[severity_min.lower()])
    return out


def kind_of(rule_id: Column, tags: Column) -> Column:
    """The kind of vulnerability that a rule looks for; null if none is known."""
    out = F.lit(None).cast("string")
    for part, kind in reversed(KINDS):
        out = F.when(F.lower(rule_id).contains(part) | F.exists(tags, lambda t: F.lower(t).contains(part)), kind).otherwise(out)  # noqa: B023
    return out


def is_secret(tags: Column) -> Column:
    return F.array_contains(tags, "secret") | F.array_contains(tags, "credentials")


def applies(rule: dict, name: Column, ext: Column) -> Column:
    """Whether a rule (a row as a dict) reads a file: by glob of its name or by a language's suffix; without either, all."""
    if not rule["file_patterns"] and not rule["languages"]:
        return F.lit(True)
    out = F.lit(False)
    for p in rule["file_patterns"]:
        out = out | name.rlike(glob(p))
    suffixes = sorted({s for x in rule["languages"] for s in RULE_SUFFIXES.get(x.lower(), ())})
    return out | ext.isin(*suffixes) if suffixes else out


def stats(rules: DataFrame) -> DataFrame:
    """One row: rules, enabled ones, those without a readable pattern, and the count of each severity."""
    severities = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return rules.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"), F.count_if(F.size("patterns") == 0).alias("dead"), *severities)


def by_owasp(rules: DataFrame) -> DataFrame:
    """Rules listed by category."""
    rows = F.sort_array(F.collect_list(F.struct("rule_id", "severity", F.array_join(F.slice("languages", 1, 3), ",").alias("languages"))))
    return rules.groupBy(F.coalesce("owasp", F.lit("Other")).alias("owasp")).agg(F.count(F.lit(1)).alias("n"), rows.alias("rules"))


def java_pattern(pattern: dict) -> str:
    return java(pattern["pattern"], ignore_case=bool(pattern["case_insensitive"]), multiline=True)
