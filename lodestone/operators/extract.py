"""Classes, functions, calls and string literals of seven languages, and endpoints and settings of web frameworks, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import java, matches
from lodestone.functions.text import basename
from lodestone.operators.findings import union_all

# Patterns by language; the first group that takes part is the name, of calls the second one the arguments.
_DOTTED_CALL = r"(\w+(?:\.\w+)*)\s*\(([^)]*)\)"
_ESCAPED_STRING = r'"([^"\\]*(?:\\.[^"\\]*)*)"'
_ANY_STRING = r"""["\']([^"\']*)["\']"""
LANGUAGES = {
    "go": ((".go",), {
        "class": r"type\s+(\w+)\s+struct\s*\{",
        "function": r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\([^)]*\)",
        "call": _DOTTED_CALL,
        "string": r'(?:"([^"\\]*(?:\\.[^"\\]*)*)"|`([^`]*)`)',
    }),
    "csharp": ((".cs", ".cshtml"), {
        "class": r"(?:public|private|internal|protected)?\s*(?:partial\s+)?class\s+(\w+)",
        "function": r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?[\w<>\[\],\s]+\s+(\w+)\s*\([^)]*\)",
        "call": _DOTTED_CALL,
        "string": r'@?"([^"\\]*(?:\\.[^"\\]*)*)"',
    }),
    "kotlin": ((".kt", ".kts"), {
        "class": r"(?:class|object|interface)\s+(\w+)",
        "function": r"fun\s+(\w+)\s*\([^)]*\)",
        "call": _DOTTED_CALL,
        "string": _ESCAPED_STRING,
    }),
    "php": ((".php",), {
        "class": r"class\s+(\w+)",
        "function": r"function\s+(\w+)\s*\(",
        "call": r"(\$?\w+(?:->|\:\:)\w+)\s*\(([^)]*)\)",
        "string": _ANY_STRING,
    }),
    "ruby": ((".rb", ".rake", ".erb"), {
        "class": r"class\s+(\w+)",
        "function": r"def\s+(\w+)",
        "call": r"(\w+(?:\.\w+)*)\s*(?:\(([^)]*)\)|(?=\s+\w))",
        "string": _ANY_STRING,
    }),
    "rust": ((".rs",), {
        "class": r"(?:pub\s+)?struct\s+(\w+)",
        "function": r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)",
        "call": r"(\w+(?:::\w+)*)\s*\(([^)]*)\)",
        "string": _ESCAPED_STRING,
    }),
    "swift": ((".swift",), {
        "class": r"(?:class|struct|enum)\s+(\w+)",
        "function": r"func\s+(\w+)",
        "call": _DOTTED_CALL,
        "string": _ESCAPED_STRING,
    }),
}
#: What parts the object of a call from its name; PHP keeps them together.
SEPARATORS = {"rust": "::", "php": None}


def _group(matched: Column, pattern: str, k: int) -> Column:
    """A group of a match, judged alone: look-aheads at its end are dropped, as what they saw is not part of it."""
    return F.regexp_extract(matched, "^" + java(pattern.replace(r"|(?=\s+\w)", "|")), k)


def extracted(files: DataFrame, language: str) -> DataFrame:
    """(file_path, kind, match_no, line_number, name, object_name, argument, text) of a language's files."""
    extensions, patterns = LANGUAGES[language]
    rows = files.filter(F.col("ext").isin(*extensions))
    parts = []
    for kind, pattern in patterns.items():
        found = rows.select(F.col("path").alias("file_path"), F.posexplode(matches(F.col("content"), java(pattern))).alias("i", "m"))
        text = F.col("m.matched")
        name, owner, argument = _group(text, pattern, 1), F.lit(None).cast("string"), F.lit(None).cast("string")
        if kind == "string" and language == "go":
            name = F.when(text.startswith("`"), _group(text, pattern, 2)).otherwise(name)
        if kind == "call":
            argument = F.nullif(_group(text, pattern, 2), F.lit(""))
            separator = SEPARATORS.get(language, ".")
            if separator:
                pieces = F.split(name, separator.replace(".", r"\."))
                owner = F.nullif(F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), separator), F.lit(""))
                name = F.element_at(pieces, -1)
        parts.append(found.select("file_path", F.lit(kind).alias("kind"), (F.col("i") + 1).cast("int").alias("match_no"), F.col("m.line").alias("line_number"), name.alias("name"), owner.alias("object_name"), argument.alias("argument"), text.alias("text")))
    return union_all(*parts)


# --- frameworks


def _listed(files: DataFrame, framework: str, pattern: str) -> DataFrame:
    rows = files.select(F.col("path").alias("file_path"), F.explode(matches(F.col("content"), java(pattern))).alias("m"))
    return rows.select(F.lit(framework).alias("framework"), F.regexp_extract("m.matched", java(pattern), 1).alias("url"), F.lit("GET").alias("http_method"), F.lit("").alias("handler"), "file_path", F.col("m.line").alias("line_number"))


def endpoints(files: DataFrame) -> DataFrame:
    """(framework, url, http_method, handler, file_path, line_number) that Django, Flask and Next.js files declare."""
    path, content = F.col("path"), F.col("content")
    django = _listed(files.filter(path.contains("urls.py")), "django", r"""path\s*\(\s*["\']([^"\']+)["\']""")
    flask = _listed(files.filter(F.col("ext") == ".py"), "flask", r"""@\w+\.route\s*\(\s*["\']([^"\']+)["\']""")
    names = lambda verb: content.contains(f"'{verb}'") | content.contains(f'"{verb}"')
    asked = content.contains("req.method")
    verbs = F.filter(F.array(F.when(asked & names("GET"), "GET"), F.when(asked & names("POST"), "POST")), lambda v: v.isNotNull())
    verbs = F.when(F.size(verbs) > 0, verbs).otherwise(F.array(F.lit("GET"), F.lit("POST")))
    routes = files.filter(path.contains("/pages/api/") | path.contains("/app/api/"))
    url = F.element_at(F.split(F.element_at(F.split(path, "/pages/api/"), -1), "/app/api/"), -1)
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    react = routes.select(F.lit("react").alias("framework"), url.alias("url"), F.explode(verbs).alias("http_method"), stem.alias("handler"), path.alias("file_path"), F.lit(1).alias("line_number"))
    return union_all(django, flask, react)


def security_settings(files: DataFrame) -> DataFrame:
    """(framework, name, value, file_path, line_number, is_secure, recommendation) of settings that are not safe."""
    path, content = F.col("path"), F.col("content")
    before = F.substring_index(content, "DEBUG = True", 1)
    line = (F.length(before) - F.length(F.translate(before, "\n", "")) + 1).cast("int")
    row = lambda framework, name, value, at, advice: [F.lit(framework).alias("framework"), F.lit(name).alias("name"), F.lit(value).cast("string").alias("value"), path.alias("file_path"), at.alias("line_number"), F.lit(False).alias("is_secure"), F.lit(advice).alias("recommendation")]
    debug = files.filter(path.contains("settings.py") & content.contains("DEBUG = True")).select(*row("django", "DEBUG", "true", line, "Set DEBUG = False in production"))
    headers = files.filter(path.contains("next.config") & ~content.contains("headers")).select(*row("react", "security_headers", None, F.lit(1), "Add security headers in next.config.js"))
    return debug.unionByName(headers)


def detected(files: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """(framework, present): whether any sign of a framework is among the files.

    A sign is ``file:`` and a lower-cased name, ``content:`` or ``import:`` and
    a pattern in any text, or ``package:`` and a dependency in a package.json.
    """
    path, content = F.col("path"), F.col("content")

    def sign(text: str) -> Column:
        kind, _, value = text.partition(":")
        if kind == "file":
            return F.lower(basename(path)) == value
        if kind in ("content", "import"):
            return content.rlike(java(value))
        if kind == "package":
            return path.contains("package.json") & content.contains(f'"{value}"')
        return F.lit(False)

    found = {}
    for framework, signs in patterns.items():
        hit = F.lit(False)
        for s in signs:
            hit = hit | sign(s)
        found[framework] = F.coalesce(F.bool_or(hit), F.lit(False))
    row = files.agg(F.array(*[F.struct(F.lit(k).alias("framework"), v.alias("present")) for k, v in found.items()]).alias("all"))
    return row.select(F.explode("all").alias("x")).select("x.*")
