"""Scalar functions of source texts and findings, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities and confidences with their ranks, report levels and scores.
SEVERITIES = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CONFIDENCES = {"high": 3, "medium": 2, "low": 1}
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}
SARIF_SCORES = {"critical": "9.0", "high": "7.0", "medium": "5.0", "low": "3.0", "info": "1.0"}

# Languages by file suffix.  The matcher and the context analysis each have their own list.
MATCHER_LANGUAGES = {
    ".java": "java", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".php": "php",
    ".cs": "csharp", ".go": "go", ".rb": "ruby", ".xml": "xml", ".yml": "yaml", ".yaml": "yaml", ".properties": "properties",
    ".html": "html", ".htm": "html", ".json": "json", ".gradle": "gradle", ".kt": "kotlin", ".scala": "scala",
}
CONTEXT_LANGUAGES = {
    ".java": "java", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".php": "php",
    ".cs": "csharp", ".go": "go", ".rb": "ruby", ".kt": "kotlin", ".scala": "scala", ".xml": "xml", ".yml": "yaml", ".yaml": "yaml",
    ".properties": "properties", ".json": "json",
}


def mapped(column: Column, table: dict, default=None) -> Column:
    """Look a value up in a small fixed table."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), F.lit(default))


def severity_rank(severity: Column) -> Column:
    return mapped(F.lower(severity), SEVERITIES, 0)


def confidence_rank(confidence: Column) -> Column:
    return mapped(F.lower(confidence), CONFIDENCES, 0)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; '' for names that only begin with one, such as .env."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for the empty text and for null."""
    text = F.coalesce(text, F.lit(""))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / F.length(text)
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


# Words that mark a value as no secret, when it is matched and when it is validated.
NOT_SECRET = ("example", "sample", "test", "demo", "placeholder", "your_", "xxx", "changeme", "password", "secret", "localhost", "http://", "https://")
#: Where a secret's value stands in a snippet.
SECRET_VALUES = (r"[\"']([A-Za-z0-9+/=_-]{20,})[\"']", r"=\s*[\"']?([A-Za-z0-9+/=_-]{20,})[\"']?")
NOT_VALID = ("example", "sample", "test", "demo", "placeholder", "your_", "xxx", "changeme", "password", "secret", "localhost", "undefined", "null", "none")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a text holds any of the words, whatever the case."""
    lower, found = F.lower(text), F.lit(False)
    for word in words:
        found = found | lower.contains(word)
    return found


def likely_secret(value: Column) -> Column:
    """At least 8 characters, no marker word, and 3.5 bits a character from 20 characters on."""
    return F.coalesce((F.length(value) >= 8) & ~has_any(value, NOT_SECRET) & ((F.length(value) < 20) | (entropy(value) >= 3.5)), F.lit(False))


def assigned_value(text: Column) -> Column:
    """What stands after the first '=', without blanks and then quotes around it; null without one."""
    after = F.regexp_extract(text, r"(?s)^[^=]*=(.*)$", 1)
    return F.when(text.contains("="), F.regexp_replace(F.regexp_replace(after, r"^\s+|\s+$", ""), r"^[\"']+|[\"']+$", ""))


def secret_value(snippet: Column) -> Column:
    """A quoted token of 20 characters or more, else an assigned one; null without either."""
    quoted, bare = (F.regexp_extract(snippet, p, 1) for p in SECRET_VALUES)
    return F.coalesce(F.when(quoted != "", quoted), F.when(bare != "", bare))


def valid_secret(snippet: Column) -> Column:
    """Whether a snippet's value, if one can be made out, has no marker word and 4 bits a character."""
    value = secret_value(snippet)
    return value.isNull() | (~has_any(value, NOT_VALID) & (entropy(value) >= 4.0))


_NOSEC = r"(?i)(?:#|//|/\*)\s*nosec\b\s*([\w,\s-]*)"


def nosec(line: Column) -> Column:
    """Rules that a suppression comment names: null without one, [] for all rules."""
    named = F.trim(F.regexp_extract(line, _NOSEC, 1))
    ids = F.filter(F.transform(F.split(named, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(line.rlike(_NOSEC), F.when(named == "", F.array().cast("array<string>")).otherwise(ids))


def suppressed(line: Column, rule_id: Column) -> Column:
    ids = nosec(line)
    return F.coalesce((F.size(ids) == 0) | F.array_contains(ids, rule_id), F.lit(False)) & ids.isNotNull()


def html_escape(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def relative_path(path: Column, base: str | None) -> Column:
    """The path below a base folder."""
    if not base:
        return path
    return F.when(path.startswith(base), F.regexp_replace(F.substr(path, F.lit(len(base) + 1)), "^/+", "")).otherwise(path)


def fingerprint(rule_id: Column, path: Column, line: Column) -> Column:
    return F.concat_ws(":", rule_id, path, line.cast("string"))


def class_guess(name: Column) -> Column:
    """A class name from a receiver: this. and self. go, words are joined with capitals."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^(?:this|self)\.", ""), "^_+", "")
    parts = F.transform(F.split(bare, "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2))))
    return F.array_join(parts, "")


def numbered_snippet(content: Column, line: Column, around: int) -> Column:
    """Lines around a line with their numbers, the line itself marked."""
    return numbered_lines(F.split(content, "\n", -1), F.lit(1), line, around)


def numbered_lines(lines: Column, at: Column, line: Column, around: int) -> Column:
    """As numbered_snippet, from a piece of a text's lines of which the first has the number ``at``."""
    first, last = F.greatest(line - around, F.lit(1)), F.least(line + around, at + F.size(lines) - 1)
    row = lambda i: F.concat(F.when(i == line, ">>>").otherwise("   "), F.lit(" "), F.lpad(i.cast("string"), 4, " "), F.lit(" | "), F.element_at(lines, (i - at + 1).cast("int")))
    return F.array_join(F.transform(F.sequence(first, last), row), "\n")


def template(text: str, values: dict[str, Column]) -> Column:
    """$name and ${name} in a text replaced by columns; other names stay."""
    out = F.lit(text)
    for name, value in values.items():
        out = F.replace(F.replace(out, F.lit("${" + name + "}"), F.coalesce(value, F.lit(""))), F.lit("$" + name), F.coalesce(value, F.lit("")))
    return out


def parsed_reply(text: Column, schema: str) -> Column:
    """A JSON object from a reply that may put it in a fenced block or among words; null if there is none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(bare), schema)
