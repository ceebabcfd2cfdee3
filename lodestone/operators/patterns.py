"""Rules matched against files: a theta join by file kind and regular expression.

The rules of a scan are a parameter, not data: each becomes literal
expressions, so that all rules are evaluated in one pass over the files,
without a join or a shuffle, and every pattern is compiled once a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import any_of, java, matches, nth_line
from lodestone.functions.text import MATCHER_LANGUAGES, assigned_value, likely_secret, mapped, suppressed, valid_secret
from lodestone.operators.findings import shaped
from lodestone.sources.rules import KINDS, applies, java_pattern

# What makes a match of a kind safe in the lines around it, and how test files are named.
SAFE = {
    "sql_injection": [r"PreparedStatement", r"createQuery\s*\([^+]*\)", r"@Param\s*\(", r"\?\s*[,)]", r":\w+", r"setString\s*\(", r"setInt\s*\(", r"setParameter\s*\("],
    "command_injection": [r"ProcessBuilder\s*\(\s*Arrays\.asList", r"new\s+String\s*\[\s*\]\s*\{", r"escapeshellarg", r"shlex\.quote"],
    "xss": [r"htmlEscape", r"escapeHtml", r"sanitize", r"encodeForHTML", r"textContent\s*=", r"innerText\s*="],
    "path_traversal": [r"getCanonicalPath", r"normalize\s*\(", r"Paths\.get\s*\([^,)]+\)", r"realpath"],
}
TEST_PARTS = ("test_", "_test.", "test.", "tests/", "/test/", "spec_", "_spec.", "spec.", "specs/", "/spec/", "__tests__", "testing/", "/testing/")
TRIPLE = (r'(?s)""".*?"""', r"(?s)'''.*?'''")
#: Rules whose expressions stand in one projection.
CHUNK = 40


def matcher_language() -> Column:
    return mapped(F.col("ext"), MATCHER_LANGUAGES, "unknown")


def test_file() -> Column:
    lower, out = F.lower("path"), F.lit(False)
    for part in TEST_PARTS:
        out = out | lower.contains(part)
    return out


def missing(content: Column, alternatives: str) -> Column:
    """Whether a text has none of the alternatives that a pattern wants missing."""
    parts = [p.strip() for p in alternatives.split("|") if p.strip()]
    out = F.lit(False)
    for p in parts:
        try:
            re.compile(p)
            out = out | content.rlike(java(p, ignore_case=True))
        except re.error:
            out = out | content.contains(p)
    return ~out


def in_triple_quotes(line: Column) -> Column:
    """Whether a line of a Python text begins inside a triple-quoted string."""
    content = F.col("content")
    start = F.length(F.array_join(F.slice(F.split(content, "\n", -1), F.lit(1), line - 1), "\n")) + F.when(line > 1, 1).otherwise(0)
    out = F.lit(False)
    for p in TRIPLE:
        pieces, found = F.split(content, p, -1), F.regexp_extract_all(content, F.lit(p), F.lit(0))
        total = lambda a, i: F.aggregate(F.slice(a, F.lit(1), i), F.lit(0), lambda x, y: x + F.length(y))
        inside = F.exists(
            F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1))),
            lambda i: (F.size(found) > 0) & (total(pieces, i) + total(found, i - 1) <= start) & (start <= total(pieces, i) + total(found, i)),  # noqa: B023
        )
        out = out | (content.rlike(p) & inside)
    return out


def kind_of_rule(rule: dict) -> str | None:
    names = [rule["rule_id"].lower(), *(t.lower() for t in rule["tags"])]
    return next((kind for part, kind in KINDS if any(part in n for n in names)), None)


def _pattern_matches(rule: dict, k: int, pattern: dict, context_aware: bool) -> Column:
    content = F.col("content")
    gate = applies(rule, F.col("name"), F.col("ext"))
    if pattern["language"]:
        gate = gate & (matcher_language() == pattern["language"].lower())
    if pattern["missing"]:
        gate = gate & missing(content, pattern["missing"])
    found = F.when(gate, matches(content, java_pattern(pattern)))
    literal = lambda x, t="string": F.lit(x).cast(t)
    strings = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rows = F.transform(
        found,
        lambda m, i: F.struct(
            literal(rule["rule_ord"], "int").alias("rule_ord"), literal(k, "int").alias("pattern_idx"), (i + 1).alias("match_no"), m["line"].alias("line_number"),
            F.coalesce(nth_line(content, m["line"]), m["matched"]).alias("line_text"), m["matched"].alias("matched"),
            *[literal(rule[c]).alias(c) for c in ("rule_id", "rule_name", "description", "severity", "confidence", "cwe", "owasp", "remediation")],
            strings(rule["references"]).alias("references"), strings(rule["tags"]).alias("tags"),
        ),
    )
    keep = lambda m: ~suppressed(m["line_text"], F.lit(rule["rule_id"]))
    rows = F.filter(rows, keep)
    kind = kind_of_rule(rule)
    if context_aware and kind in SAFE:
        lines = F.split(content, "\n", -1)
        first = lambda m: F.greatest(m["line_number"] - 2, F.lit(1))
        near = lambda m: F.array_join(F.slice(lines, first(m), m["line_number"] + 3 - first(m)), "\n")
        rows = F.filter(rows, lambda m: ~any_of(near(m), SAFE[kind]))
    if context_aware:
        rows = F.filter(rows, lambda m: ~((matcher_language() == "python") & in_triple_quotes(m["line_number"])))
    if context_aware and {"secret", "credentials"} & set(rule["tags"]):
        rows = F.filter(rows, lambda m: valid_secret(F.left(F.trim(m["line_text"]), F.lit(200))))
    if {"secret", "credentials"} & set(rule["tags"]):
        rows = F.filter(rows, lambda m: ~F.coalesce(~likely_secret(assigned_value(F.left(m["matched"], F.lit(100)))), F.lit(False)) | ~F.left(m["matched"], F.lit(100)).contains("="))
    return F.coalesce(rows, F.array())


def match_rules(files: DataFrame, rules: DataFrame, context_aware: bool = True, skip_tests: bool = False, exact: bool = False) -> DataFrame:
    """Findings of all enabled rules in files.

    exact: Python's own engine in vectorised batches, for patterns that Java
    reads otherwise; by default all work stays in built-in expressions.
    """
    chosen = [r.asDict(recursive=True) for r in rules.filter("enabled").orderBy("rule_ord").collect()]  # a scan's rules: a parameter
    base = files.filter(~test_file()) if skip_tests else files
    if exact:
        return _match_exactly(base, chosen, context_aware)
    parts = [_pattern_matches(r, k, p, context_aware) for r in chosen for k, p in enumerate(r["patterns"])]
    if not parts:
        return shaped(base.limit(0).select(F.col("path").alias("file_path")))
    found = None
    for at in range(0, len(parts), CHUNK):
        one = base.select("path", F.explode(F.concat(*parts[at : at + CHUNK])).alias("m"))
        found = one if found is None else found.unionByName(one)
    found = found.select(F.col("path").alias("file_path"), "m.*")
    secret = F.array_contains("tags", "secret") | F.array_contains("tags", "credentials")
    return shaped(found, engine=F.when(secret, "secret").otherwise("pattern"), engine_seq=F.when(secret, 2).otherwise(1), snippet=F.left(F.trim("line_text"), F.lit(200)), matched_pattern=F.left("matched", F.lit(100)))


def _match_exactly(files: DataFrame, rules: list[dict], context_aware: bool) -> DataFrame:
    """The same relation by Python's regular expressions; what surrounds a match is judged by the same columns after it."""
    compiled = []
    for r in rules:
        for k, p in enumerate(r["patterns"]):
            try:
                compiled.append((r["rule_ord"], k, p, re.compile(p["pattern"], re.MULTILINE | (re.IGNORECASE if p["case_insensitive"] else 0))))
            except re.error:
                continue

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                for ord_, k, _, pattern in compiled:
                    for n, m in enumerate(pattern.finditer(content), 1):
                        rows.append((path, ord_, k, n, content.count("\n", 0, m.start()) + 1, m[0]))
            yield pd.DataFrame(rows, columns=["path", "rule_ord", "pattern_idx", "match_no", "line_number", "matched"])

    found = files.select("path", "content").mapInPandas(run, "path string, rule_ord int, pattern_idx int, match_no int, line_number int, matched string")
    joined = found.join(files, "path")
    out = None
    for r, group in groupby(((r, k, p) for r in rules for k, p in enumerate(r["patterns"])), key=lambda x: x[0]):
        gates, kind = None, kind_of_rule(r)
        for _, k, p in group:
            gate = (F.col("rule_ord") == r["rule_ord"]) & (F.col("pattern_idx") == k)
            if p["language"]:
                gate = gate & (matcher_language() == p["language"].lower())
            if p["missing"]:
                gate = gate & missing(F.col("content"), p["missing"])
            gates = gate if gates is None else gates | gate
        if gates is None:
            continue
        line = F.coalesce(nth_line(F.col("content"), F.col("line_number")), F.col("matched"))
        keep = gates & applies(r, F.col("name"), F.col("ext")) & ~suppressed(line, F.lit(r["rule_id"]))
        if context_aware:
            keep = keep & ~((matcher_language() == "python") & in_triple_quotes(F.col("line_number")))
            if kind in SAFE:
                first = F.greatest(F.col("line_number") - 2, F.lit(1))
                keep = keep & ~any_of(F.array_join(F.slice(F.split("content", "\n", -1), first, F.col("line_number") + 3 - first), "\n"), SAFE[kind])
        secret = bool({"secret", "credentials"} & set(r["tags"]))
        if secret:
            short = F.left("matched", F.lit(100))
            keep = keep & (~short.contains("=") | likely_secret(assigned_value(short)))
            if context_aware:
                keep = keep & valid_secret(F.left(F.trim(line), F.lit(200)))
        values = {c: r[c] for c in ("rule_id", "rule_name", "description", "severity", "confidence", "cwe", "owasp", "remediation")}
        lists = {c: F.array(*map(F.lit, r[c])).cast("array<string>") for c in ("references", "tags")}
        one = shaped(joined.filter(keep), engine="secret" if secret else "pattern", engine_seq=2 if secret else 1, file_path=F.col("path"), snippet=F.left(F.trim(line), F.lit(200)), matched_pattern=F.left("matched", F.lit(100)), **values, **lists)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else shaped(files.limit(0).select(F.col("path").alias("file_path")))
