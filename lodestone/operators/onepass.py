"""All rules and check tables over files in one vectorised pass.

For a whole scan, hundreds of patterns as column expressions cost more to
plan than to run.  Here the patterns are compiled once in each task and every
file of a batch is searched by those that apply to it and that its words do
not rule out (manypatterns): one scan of the files,
no shuffle, memory of one batch, and Python's own regular expressions.
``patterns`` and ``checks`` give the same rows as built-in expressions.
"""

from __future__ import annotations

import logging
import re
from bisect import bisect_right
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import cache, cached_property
from math import log2

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import MATCHER_LANGUAGES, NOT_SECRET, NOT_VALID, SECRET_VALUES
from lodestone.operators.check_tables import CLOUDFORMATION, DOCKERFILE, FRAMEWORKS, KUBERNETES, LANGUAGES, TERRAFORM, Check
from lodestone.operators.checks import SEQUENCE, frameworks
from lodestone.operators.findings import COLUMNS, shaped
from lodestone.operators.manypatterns import Candidates
from lodestone.operators.patterns import SAFE, kind_of_rule
from lodestone.sources.rules import RULE_SUFFIXES

ROW = [c for c in COLUMNS if c != "metadata"]
_TRIPLE = re.compile(r'""".*?"""', re.S), re.compile(r"'''.*?'''", re.S)
_NOSEC = re.compile(r"(?:#|//|/\*)\s*nosec\b\s*([\w,\s-]*)", re.I)

_FLAGS = {"i": re.I, "m": re.M, "s": re.S}


@cache
def _compiled(pattern: str, flags: str) -> re.Pattern:
    return re.compile(pattern, sum(_FLAGS[f] for f in flags))


class Text:
    """A file with what several patterns ask of it."""

    def __init__(self, path: str, name: str, ext: str, content: str, candidates: Candidates | None = None):
        self.path, self.name, self.ext, self.content, self.candidates = path, name, ext, content, candidates
        self.lines = content.split("\n")

    @cached_property
    def possible(self) -> set[tuple[str, str]]:
        return self.candidates.of(self.content)

    def found(self, pattern: str, flags: str) -> list[re.Match]:
        """All matches of a pattern; none without a search if the file has nothing that it must contain."""
        if self.candidates is not None and (pattern, flags) not in self.possible:
            return []
        return list(_compiled(pattern, flags).finditer(self.content))

    @cached_property
    def ends(self) -> list[int]:
        """Where the line feeds are."""
        return [m.start() for m in re.finditer("\n", self.content)]

    @cached_property
    def quoted(self) -> list[tuple[list[int], list[int]]]:
        """Begins and ends of triple-quoted strings, for each kind of quote."""
        return [([x.start() for x in p.finditer(self.content)], [x.end() for x in p.finditer(self.content)]) for p in _TRIPLE]

    def line_of(self, at: int) -> int:
        return bisect_right(self.ends, at - 1) + 1

    def in_quotes(self, at: int) -> bool:
        """Whether a place is in a triple-quoted string or at its edge."""
        return any((k := bisect_right(begins, at)) and at <= ends[k - 1] for begins, ends in self.quoted)

    def row(self, **given) -> tuple:
        return tuple(given.get(c, self.path if c == "file_path" else [] if c in ("references", "tags") else None) for c in ROW)


def entropy(text: str) -> float:
    return -sum(p * log2(p) for p in (text.count(c) / len(text) for c in set(text))) if text else 0.0


def valid_secret(snippet: str) -> bool:
    """Whether a snippet's value, if one can be made out, has no marker word and 4 bits a character."""
    value = next((m[1] for p in SECRET_VALUES if (m := _compiled(p, "").search(snippet))), None)
    return value is None or (not any(w in value.lower() for w in NOT_VALID) and entropy(value) >= 4.0)


def _named(line: str) -> set[str] | None:
    found = _NOSEC.search(line)
    return found and {x.strip() for x in found[1].split(",") if x.strip()}


def applies(rule: dict, text: Text) -> bool:
    if not rule["file_patterns"] and not rule["languages"]:
        return True
    return any(fnmatchcase(text.name, p) for p in rule["file_patterns"]) or any(text.ext in RULE_SUFFIXES.get(x.lower(), ()) for x in rule["languages"])


def _absent(content: str, alternatives: str) -> bool:
    for part in filter(None, map(str.strip, alternatives.split("|"))):
        try:
            if _compiled(part, "i").search(content):
                return False
        except re.error:
            if part in content:
                return False
    return True


def _rule_pattern(pattern: dict) -> tuple[str, str]:
    return pattern["pattern"], "mi" if pattern["case_insensitive"] else "m"


def candidates_of(rules: list[dict], engines: set[str]) -> Candidates:
    """Of all patterns that a scan searches for, those that can match a file."""
    wanted = {_rule_pattern(p) for r in rules for p in r["patterns"]}
    tables = [t for name, of in (("frameworks", FRAMEWORKS), ("languages", LANGUAGES)) if name in engines for _, t in of.values()]
    tables += [TERRAFORM, KUBERNETES, DOCKERFILE, CLOUDFORMATION] if "iac" in engines else []
    wanted.update((p, check.flags) for table in tables for check in table for p in check.patterns)
    return Candidates({(p, flags): (p, sum(_FLAGS[f] for f in flags)) for p, flags in wanted})


def rule_rows(text: Text, rule: dict, context_aware: bool) -> Iterator[tuple]:
    """A rule's findings in a file."""
    if not applies(rule, text):
        return
    language, kind = MATCHER_LANGUAGES.get(text.ext, "unknown"), kind_of_rule(rule)
    secret = bool({"secret", "credentials"} & set(rule["tags"]))
    safe = SAFE.get(kind, ()) if context_aware else ()
    for k, pattern in enumerate(rule["patterns"]):
        if pattern["language"] and pattern["language"].lower() != language:
            continue
        try:
            found = text.found(*_rule_pattern(pattern))
        except re.error:
            continue
        if not found or (pattern["missing"] and not _absent(text.content, pattern["missing"])):
            continue
        for n, m in enumerate(found, 1):
            line = text.line_of(m.start())
            words = text.lines[line - 1]
            named = _named(words)
            if named is not None and (not named or rule["rule_id"] in named):
                continue
            near = "\n".join(text.lines[max(0, line - 3) : line + 2])
            if any(_compiled(p, "i").search(near) for p in safe):
                continue
            if context_aware and language == "python" and text.in_quotes(text.content.rfind("\n", 0, m.start()) + 1):
                continue
            if secret and context_aware and not valid_secret(words.strip()[:200]):
                continue
            matched = m[0][:100]
            if secret and "=" in matched:
                value = matched.split("=", 1)[1].strip().strip("\"'")
                if len(value) < 8 or any(w in value.lower() for w in NOT_SECRET) or (len(value) >= 20 and entropy(value) < 3.5):
                    continue
            yield text.row(
                engine="secret" if secret else "pattern", engine_seq=2 if secret else 1, rule_ord=rule["rule_ord"], pattern_idx=k, match_no=n, line_number=line, snippet=words.strip()[:200], matched_pattern=matched,
                **{c: rule[c] for c in ("rule_id", "rule_name", "description", "severity", "confidence", "cwe", "owasp", "remediation", "references", "tags")},
            )


def check_rows(text: Text, check: Check, ordinal: int, engine: str, sequence: int, width: int = 0) -> Iterator[tuple]:
    """A check's findings in a file; width: of a snippet that is the match, and not its line."""
    content = text.content
    if (check.extensions and text.ext not in check.extensions) or (check.has and not any(x in content for x in check.has)):
        return
    if (check.hasnt and any(x in content for x in check.hasnt)) or (check.path and check.path not in text.path.lower()):
        return
    fixed = {"engine": engine, "engine_seq": sequence, "rule_ord": ordinal, "rule_id": check.rule_id, "rule_name": check.title, "confidence": check.confidence, "cwe": check.cwe, "owasp": check.owasp}
    at_top = {"line_number": 1, "match_no": 1, "severity": check.severity, "matched_pattern": "", "snippet": "" if width else text.lines[0].strip()[:200]}
    if check.absent:
        yield text.row(**fixed, **at_top, pattern_idx=0)
        return
    for k, pattern in enumerate(check.patterns):
        found = text.found(pattern, check.flags)
        if check.above:
            if len(found) > check.above:
                yield text.row(**fixed, **at_top, pattern_idx=k)
            continue
        for n, m in enumerate(found[: check.only or None], 1):
            around = content[max(0, m.start() - check.around[0]) : m.end() + check.around[1]]
            if check.within and not any(x in m[0].lower() for x in check.within):
                continue
            if check.near and any(x in (around if check.around[0] else around.lower()) for x in check.near):
                continue
            line = text.line_of(m.start())
            severity = check.raised if check.raised and any(x in around for x in check.raised_by) else check.severity
            yield text.row(**fixed, pattern_idx=k, match_no=n, line_number=line, severity=severity, matched_pattern=m[0][:100], snippet=m[0][:width] if width else text.lines[line - 1].strip()[:200])


def _php_rows(text: Text) -> Iterator[tuple]:
    tainted = set(_compiled(r"\$(\w+)\s*=\s*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)", "").findall(text.content))
    for n, m in enumerate(_compiled(r"(?:exec|shell_exec|system|passthru|popen)\s*\(\s*\$(\w+)\s*\)", "").finditer(text.content), 1):
        if m[1] in tainted:
            line = text.line_of(m.start())
            yield text.row(engine="language:php", engine_seq=SEQUENCE["language"] + list(LANGUAGES).index("php"), rule_ord=1, pattern_idx=2, match_no=n, rule_id="PHP-CMDI-001", rule_name="Command Injection", severity="critical", confidence="high", cwe="CWE-78", owasp="A03", line_number=line, snippet=text.lines[line - 1].strip(), matched_pattern=m[0])


def _infrastructure(text: Text) -> Iterator[tuple[str, int, tuple[Check, ...], int]]:
    has, name = text.content.__contains__, text.name.lower()
    base = SEQUENCE["iac"]
    if text.ext in (".tf", ".tfvars"):
        yield "iac:terraform", base, TERRAFORM, 80
    if text.ext in (".yaml", ".yml") and has("apiVersion:") and has("kind:"):
        yield "iac:kubernetes", base + 1, KUBERNETES, 60
    if name == "dockerfile" or name.startswith("dockerfile."):
        yield "iac:dockerfile", base + 2, DOCKERFILE, 60
    if text.ext in (".yaml", ".yml", ".json") and (has("AWSTemplateFormatVersion") or has("Resources:")):
        yield "iac:cloudformation", base + 3, CLOUDFORMATION, 60


def all_rows(text: Text, rules: list[dict], present: set[str], engines: set[str], context_aware: bool, plain: bool) -> Iterator[tuple]:
    """Everything that rules and check tables find in one file; plain: whether rules read it."""
    if plain:
        for rule in rules:
            yield from rule_rows(text, rule, context_aware)
    if not text.content:
        return
    if "frameworks" in engines:
        for k, (name, (extensions, table)) in enumerate(FRAMEWORKS.items()):
            if name in present and text.ext in extensions:
                for i, check in enumerate(table):
                    yield from check_rows(text, check, i, f"framework:{name}", SEQUENCE["framework"] + k)
    if "languages" in engines:
        for k, (name, (extensions, table)) in enumerate(LANGUAGES.items()):
            if text.ext in extensions:
                for i, check in enumerate(table):
                    yield from check_rows(text, check, i, f"language:{name}", SEQUENCE["language"] + k)
        if text.ext in LANGUAGES["php"][0]:
            yield from _php_rows(text)
    if "iac" in engines:
        for engine, sequence, table, width in _infrastructure(text):
            for i, check in enumerate(table):
                yield from check_rows(text, check, i, engine, sequence, width)


def scan(files: DataFrame, rules: DataFrame, engines: tuple[str, ...], context_aware: bool = True, present: set[str] | None = None) -> DataFrame:
    """Findings of rules and check tables.

    files may have a column ``plain``: whether rules read the file.  present:
    the frameworks whose checks apply; by default those that the files show.
    """
    chosen = [r.asDict(recursive=True) for r in rules.orderBy("rule_ord").collect()] if "rules" in engines else []  # a scan's rules: a parameter
    if present is None:
        present = {r.framework for r in frameworks(files).filter("present").collect()} if "frameworks" in engines else set()  # 14 at most
    wanted = set(engines)
    if "plain" not in files.columns:
        files = files.withColumn("plain", F.lit(True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        candidates = candidates_of(chosen, wanted)
        for batch in batches:
            rows = []
            for path, name, ext, content, plain in batch.itertuples(index=False, name=None):
                try:
                    rows.extend(all_rows(Text(path, name, ext, content or "", candidates), chosen, present, wanted, context_aware, plain))
                except Exception:  # one file must not end the scan of the others
                    logging.getLogger(__name__).exception("not scanned: %s", path)
            yield pd.DataFrame(rows, columns=ROW)

    schema = ", ".join(f"`{c}` {COLUMNS[c]}" for c in ROW)
    return shaped(files.select("path", "name", "ext", "content", "plain").mapInPandas(run, schema))
