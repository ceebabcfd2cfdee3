"""Reports of findings: tables for CSV and SARIF, and the texts of one report."""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from lodestone.functions.text import SARIF_LEVELS, SARIF_SCORES, fingerprint, html_escape, mapped, relative_path, severity_rank
from lodestone.operators.findings import numbered, ordered, summary, top_categories
from lodestone.plans import documents

#: Findings that a page shows, and categories of its summary.
PAGE_ROWS, PAGE_CATEGORIES = 200, 8


def csv_table(findings: DataFrame) -> DataFrame:
    """The columns of a CSV report; a row's id is its place in the report."""
    return numbered(findings).select(
        "finding_id", "rule_id", "rule_name", "severity", "confidence", "file_path", "line_number", "cwe", "owasp", "description", F.array_join("tags", ",").alias("tags"), "snippet", "remediation"
    )


def write_csv(findings: DataFrame, path: str) -> None:
    csv_table(findings).write.option("header", True).option("quoteAll", True).csv(path)


def json_rows(findings: DataFrame) -> DataFrame:
    """Findings as one JSON object a row, in report order."""
    kept = [c for c in findings.columns if c not in ("engine_seq", "rule_ord", "pattern_idx", "match_no")]
    return ordered(findings).select(F.to_json(F.struct(*kept)).alias("value"))


def sarif_rules(findings: DataFrame, base: str | None = None) -> DataFrame:
    """(rule_id, rule_index, level, security_severity, tags): rules in the order in which the report first shows them."""
    rows = numbered(findings)
    first = rows.groupBy("rule_id").agg(F.min(F.struct("finding_no", "rule_name", "severity", "cwe", "owasp", "tags")).alias("f"))
    index = F.row_number().over(Window.orderBy("f.finding_no")) - 1  # a row a rule: the rules of a scan
    tags = F.array_compact(F.concat("f.tags", F.array("f.cwe", "f.owasp")))
    return first.select("rule_id", index.alias("rule_index"), F.col("f.rule_name").alias("rule_name"), mapped(F.col("f.severity"), SARIF_LEVELS, "warning").alias("level"), mapped(F.col("f.severity"), SARIF_SCORES, "5.0").alias("security_severity"), tags.alias("tags"))


def sarif_results(findings: DataFrame, base: str | None = None) -> DataFrame:
    """(finding_no, rule_id, rule_index, level, uri, line_number, fingerprint, partial) and what a result shows beside them."""
    rows = numbered(findings).join(sarif_rules(findings).select("rule_id", "rule_index"), "rule_id")
    uri = relative_path(F.col("file_path"), base)
    key = fingerprint(F.col("rule_id"), uri, F.col("line_number"))
    severity = F.col("severity")
    return rows.select(
        "finding_no", "rule_id", "rule_index", mapped(severity, SARIF_LEVELS, "warning").alias("level"), uri.alias("uri"), "line_number", key.alias("fingerprint"), F.crc32(key.cast("binary")).alias("partial"),
        F.coalesce("description", "rule_name", F.lit("")).alias("message"), "snippet", mapped(severity, SARIF_SCORES, "5.0").alias("security_severity"), "confidence", "cwe", "owasp",
    )


#: Files that a SARIF document lists as scanned.
SARIF_FILES = 1000


def timestamp(moment: datetime | None = None) -> str:
    """A moment (now) in UTC, as ISO 8601 with a Z."""
    return (moment or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def visible(findings: DataFrame, include_suppressed: bool = False) -> DataFrame:
    """findings less those whose metadata says that they are suppressed."""
    return findings if include_suppressed else findings.filter(F.coalesce(F.col("metadata")["suppressed"], F.lit("false")) != "true")


def _one_rule(r: Row) -> dict:
    rule = {"id": r.rule_id, "name": r.rule_name, "defaultConfiguration": {"level": r.level}, "properties": {"security-severity": r.security_severity, "tags": r.tags}}
    cwe = next((t for t in r.tags or () if re.fullmatch(r"CWE-\d+", t)), None)
    return rule | ({"helpUri": f"https://cwe.mitre.org/data/definitions/{cwe[4:]}.html"} if cwe else {})


def sarif_rows(findings: DataFrame, base: str | None = None) -> DataFrame:
    """SARIF results as one JSON object a row, in report order; what is empty is left out."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    region = F.struct(F.col("line_number").alias("startLine"), F.lit(1).alias("startColumn"), F.when(F.col("snippet") != "", F.struct(F.left("snippet", F.lit(500)).alias("text"))).alias("snippet"))
    place = F.struct(F.struct(F.struct(F.col("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.struct(some("security_severity").alias("security-severity"), some("confidence").alias("confidence"), some("cwe").alias("cwe"), some("owasp").alias("owasp")).alias("properties"),
        F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("fingerprints"), F.struct(F.col("partial").cast("string").alias("primaryLocationLineHash")).alias("partialFingerprints"), F.array(place).alias("locations"),
    )
    return sarif_results(findings, base).orderBy("finding_no").select(F.to_json(result).alias("value"))


def _sarif_frame(shown: DataFrame, tool: str, version: str, base: str | None, scanned: DataFrame | None) -> tuple[str, str]:
    """A SARIF document's text before and after its results; scanned: (path) of files to list, a thousand at most."""
    rules = [_one_rule(r) for r in sarif_rules(shown).orderBy("rule_index").collect()]  # a scan's rules
    run = {"tool": {"driver": {"name": tool, "version": version, "rules": rules}}, "invocations": [{"executionSuccessful": True, "endTimeUtc": timestamp()}]}
    run["originalUriBaseIds"] = {"%SRCROOT%": {"uri": f"file://{base}/" if base else ""}}
    if scanned is not None:
        listed = scanned.select(relative_path(F.col("path"), base).alias("uri")).orderBy("uri").limit(SARIF_FILES)
        run["artifacts"] = [{"location": {"uri": r.uri, "uriBaseId": "%SRCROOT%"}} for r in listed.collect()]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json"})[:-1] + ', "runs": [' + json.dumps(run)[:-1] + ', "results": [', "]}]}"


def write_sarif(findings: DataFrame, path: str, tool: str, version: str, base: str | None = None, scanned: DataFrame | None = None, include_suppressed: bool = False) -> None:
    """Write a whole SARIF document; its results are written by executors."""
    shown = visible(findings, include_suppressed)
    head, foot = _sarif_frame(shown, tool, version, base, scanned)
    documents.write(sarif_rows(shown, base), path, head, ", ", foot)


def sarif(findings: DataFrame, tool: str, version: str, base: str | None = None, scanned: DataFrame | None = None, include_suppressed: bool = False) -> str:
    """A whole SARIF document as one text, for reports that one text can hold."""
    shown = visible(findings, include_suppressed)
    head, foot = _sarif_frame(shown, tool, version, base, scanned)
    return head + ", ".join(r.value for r in sarif_rows(shown, base).collect()) + foot


def write_json(findings: DataFrame, path: str, info: dict, errors: list[str] | None = None) -> None:
    """Write a whole JSON report: scan_info, summary, total, findings and errors; findings are written by executors."""
    counts = {r.severity: r.n for r in summary(findings).collect()}
    head = {"scan_info": {"timestamp": timestamp()} | info, "summary": counts, "total_findings": sum(counts.values()), "errors": errors or []}
    documents.write(json_rows(findings), path, json.dumps(head)[:-1] + ', "findings": [', ", ", "]}")


def write_enhanced_json(replies: DataFrame, path: str, info: dict, usage: dict) -> None:
    """Write a JSON report of findings with a model's verdicts."""
    kept = [c for c in replies.columns if c not in ("prompt", "reply", "engine_seq", "rule_ord", "pattern_idx", "match_no")]
    head = json.dumps({"timestamp": timestamp()} | info | {"llm_stats": usage})[:-1] + ', "enhanced_findings": ['
    documents.write(replies.select(F.to_json(F.struct(*kept)).alias("value")), path, head, ", ", "]}")


def console(findings: DataFrame, rows: int = 50) -> str:
    """A plain text report: counts by severity and the first findings."""
    counts = {r.severity: r.n for r in summary(findings).collect()}
    out = ["  ".join(f"{k}: {v}" for k, v in counts.items())]
    for r in ordered(findings).limit(rows).collect():
        out.append(f"[{r.severity.upper()}] {r.rule_id} {r.file_path}:{r.line_number} {(r.snippet or '')[:80]}")
    return "\n".join(out)


def html(findings: DataFrame, title: str) -> str:
    """A page with counts, the most frequent categories and the first findings."""
    counts = {r.severity: r.n for r in summary(findings).collect()}
    categories = top_categories(findings, PAGE_CATEGORIES).collect()
    cell = lambda c: html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c)
    rows = ordered(findings).limit(PAGE_ROWS).select(*[cell(c) for c in ("severity", "rule_id", "rule_name", "file_path", "line_number", "snippet")]).collect()
    body = "".join(f"<tr class='{r.severity}'><td>{r.severity}</td><td>{r.rule_id}</td><td>{r.rule_name}</td><td>{r.file_path}:{r.line_number}</td><td><code>{r.snippet}</code></td></tr>" for r in rows)
    more = sum(counts.values()) - len(rows)
    return (
        f"<!doctype html><meta charset='utf-8'><title>{title}</title><h1>{title}</h1><p>{', '.join(f'{k}: {v}' for k, v in counts.items())}</p>"
        f"<ul>{''.join(f'<li>{c.category}: {c.n}</li>' for c in categories)}</ul><table>{body}</table>" + (f"<p>{more} more</p>" if more > 0 else "")
    )


def rule_listing(rules: DataFrame) -> DataFrame:
    """Rules by category and severity."""
    return rules.select(F.coalesce("owasp", F.lit("Other")).alias("owasp"), "rule_id", "severity", F.array_join(F.slice("languages", 1, 3), ",").alias("languages")).orderBy("owasp", severity_rank(F.col("severity")).desc(), "rule_id")
