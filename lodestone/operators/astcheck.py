"""Dangerous calls with tainted or concatenated arguments, from the structure of Java and Go files.

The tables are searched per call in one vectorised pass over the files; a
file that cannot be read gives no rows and does not end the pass.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import scriptcode
from lodestone.functions.javacode import Java, blanked, parts
from lodestone.functions.text import mapped
from lodestone.operators.check_tables import LANGUAGES
from lodestone.operators.checks import SEQUENCE
from lodestone.operators.findings import shaped

# Names of dangerous calls by kind, words of request values, and what kinds are called.
JAVA_SINKS = {
    "sql_injection": ("executeQuery", "executeUpdate", "execute", "prepareStatement", "createNativeQuery", "createQuery", "nativeQuery"),
    "command_injection": ("exec", "getRuntime().exec", "ProcessBuilder", "Runtime.exec"),
    "path_traversal": ("new File", "Paths.get", "FileInputStream", "FileOutputStream", "FileReader", "FileWriter", "readFile", "writeFile"),
    "ssrf": ("openConnection", "URL", "HttpURLConnection", "HttpClient", "RestTemplate", "WebClient"),
    "deserialization": ("ObjectInputStream", "readObject", "readUnshared", "XMLDecoder", "fromXML"),
    "xss": ("getWriter().print", "getWriter().write", "getOutputStream", "sendRedirect", "forward"),
}
JAVA_SOURCES = (
    "getParameter", "getHeader", "getCookies", "getInputStream", "getReader", "getQueryString", "getPathInfo", "getRequestURI", "getRequestURL", "getAttribute", "getSession",
    "@RequestParam", "@PathVariable", "@RequestBody", "@RequestHeader",
)
CWES = {"sql_injection": "CWE-89", "command_injection": "CWE-78", "path_traversal": "CWE-22", "ssrf": "CWE-918", "deserialization": "CWE-502", "xss": "CWE-79"}
GO_SINKS = {
    "GO-SQLI-001": ("Potential SQL Injection", "high", "CWE-89", "A03", ("Query", "QueryRow", "QueryContext", "QueryRowContext", "Exec", "ExecContext", "Prepare", "PrepareContext", "Raw", "RawQuery")),
    "GO-CMDI-001": ("Potential Command Injection", "critical", "CWE-78", "A03", ("Command", "CommandContext", "Run", "Start", "Output", "CombinedOutput")),
    "GO-PATH-001": ("Potential Path Traversal", "high", "CWE-22", "A01", ("Open", "OpenFile", "Create", "Remove", "RemoveAll", "ReadFile", "WriteFile", "ReadDir", "Stat", "Lstat", "MkdirAll", "Mkdir", "Rename", "Chmod", "Chown")),
    "GO-SSRF-001": ("Potential SSRF", "high", "CWE-918", "A10", ("Get", "Post", "PostForm", "Head", "Do", "NewRequest", "NewRequestWithContext")),
}
GO_SOURCES = (
    r"r\.URL\.Query", r"r\.FormValue", r"r\.PostFormValue", r"r\.Header\.Get", r"r\.Body", r"r\.PathValue", r"r\.Cookie",
    r"c\.Query", r"c\.Param", r"c\.PostForm", r"c\.GetHeader", r"c\.BindJSON", r"c\.ShouldBindJSON", r"c\.QueryParam", r"c\.FormValue", r"c\.Params", r"c\.Body",
    r"os\.Args", r"os\.Getenv", r"bufio\.NewReader",
)
REMEDIES = {
    "sql_injection": "Bind values as parameters of prepared statements.",
    "command_injection": "Keep request values out of commands, or allow only listed ones.",
    "path_traversal": "Check a path in its canonical form against allowed folders.",
    "ssrf": "Allow only listed hosts and protocols.",
    "deserialization": "Read untrusted data in a format without types of its own, such as JSON.",
    "xss": "Encode output for its place in the page.",
}


def java_calls(content: str) -> Iterator[tuple[str, str, int, str, bool]]:
    """(kind, sink, line, code, sure) of calls that hold a dangerous name and a tainted or concatenated argument."""
    source = Java(content)
    tainted = {name for name, value in source.assignments() if any(s in value for s in JAVA_SOURCES)}
    for call in source.calls():
        if not any(("+" in a and '"' in a) or any(t in a for t in tainted) for a in call.arguments):
            continue
        for kind, sinks in JAVA_SINKS.items():
            for sink in sinks:
                if sink in call.name or sink in call.text:
                    yield kind, sink, source.line_of(call.start), call.text, any(s in call.text for s in JAVA_SOURCES)


_GO_CALL = re.compile(r"([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\(")
_GO_WORDS = frozenset("if for switch select func return go defer range case var const type import".split())
_GO_SOURCE = re.compile("|".join(GO_SOURCES))


def go_calls(content: str) -> Iterator[tuple[str, str, int, str]]:
    """(rule id, name, line, code) of calls of dangerous names with request values, concatenation or formatting."""
    code = blanked(re.sub(r"`[^`]*`", lambda m: '"' + re.sub(r'[^\n]', "_", m[0][1:-1]) + '"', content))
    for m in _GO_CALL.finditer(code):
        name = m[1].rsplit(".", 1)[-1].strip()
        rules = [r for r, x in GO_SINKS.items() if name in x[4]]
        if not rules or m[1] in _GO_WORDS or re.search(r"\bfunc\s+(?:\([^)]*\)\s*)?$", code[max(0, m.start() - 200) : m.start()]):
            continue
        depth, end = 0, m.end() - 1
        for end in range(m.end() - 1, len(code)):
            depth += (code[end] == "(") - (code[end] == ")")
            if not depth:
                break
        text = content[m.start() : end + 1]
        arguments = parts(code[m.end() : end], content[m.end() : end])
        if "+" in text or "fmt.Sprintf" in text or any(_GO_SOURCE.search(a) for a in arguments):
            for rule in rules:
                yield rule, name, content.count("\n", 0, m.start()) + 1, text


def _each(files: DataFrame, read: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of a reader for every file, with its path and their number in it."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False, name=None):
                try:
                    rows.extend((path, k, *x) for k, x in enumerate(read(content or "")))
                except Exception:  # one file must not end the pass over the others
                    logging.getLogger(__name__).exception("not read: %s", path)
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def script_calls(files: DataFrame) -> DataFrame:
    """(file_path, n, function, line, arguments, code) of the calls in Python, JavaScript and TypeScript files."""
    schema = "file_path string, n int, function string, line int, arguments array<string>, code string"
    python = _each(files.filter(F.col("ext") == ".py"), scriptcode.python_calls, schema)
    return python.unionByName(_each(files.filter(F.col("ext").isin(".js", ".jsx", ".ts", ".tsx")), scriptcode.script_calls, schema))


def python_functions(files: DataFrame) -> DataFrame:
    """(file_path, n, name, first_line, last_line, parameters) of the functions in Python files."""
    return _each(files.filter(F.col("ext") == ".py"), scriptcode.python_functions, "file_path string, n int, name string, first_line int, last_line int, parameters array<string>")


def java_findings(files: DataFrame) -> DataFrame:
    """AST-<KIND>-001 of Java files."""
    rows = _each(files.filter(F.col("ext") == ".java"), java_calls, "file_path string, n int, kind string, sink string, line int, code string, sure boolean")
    kind = F.col("kind")
    return shaped(
        rows,
        engine="ast",
        engine_seq=3,
        rule_ord=F.array_position(F.array(*map(F.lit, JAVA_SINKS)), kind),
        pattern_idx=0,
        match_no=F.col("n"),
        line_number=F.col("line"),
        rule_id=F.concat(F.lit("AST-"), F.upper(kind), F.lit("-001")),
        rule_name=F.concat(F.lit("Potential "), F.initcap(F.translate(kind, "_", " ")), F.lit(" (AST Analysis)")),
        description=F.concat(F.lit("AST analysis detected a potentially vulnerable pattern: "), F.col("sink"), F.lit(" is called with potentially tainted data.")),
        severity="high",
        confidence=F.when(F.col("sure"), "high").otherwise("medium"),
        snippet=F.left("code", F.lit(200)),
        tags=F.array(kind, F.lit("ast-analysis"), F.lit("taint-tracking")),
        cwe=mapped(kind, CWES),
        remediation=mapped(kind, REMEDIES),
    )


def go_findings(files: DataFrame) -> DataFrame:
    """GO-SQLI-001, GO-CMDI-001, GO-PATH-001 and GO-SSRF-001 of Go files."""
    rows = _each(files.filter(F.col("ext") == ".go"), go_calls, "file_path string, n int, rule_id string, name string, line int, code string")
    value = lambda k: mapped(F.col("rule_id"), {r: x[k] for r, x in GO_SINKS.items()})
    return shaped(
        rows,
        engine="language:go",
        engine_seq=SEQUENCE["language"] + list(LANGUAGES).index("go"),
        rule_ord=-1,
        pattern_idx=F.col("n"),
        match_no=F.col("n"),
        line_number=F.col("line"),
        rule_name=value(0),
        severity=value(1),
        confidence="medium",
        cwe=value(2),
        owasp=value(3),
        snippet=F.left("code", F.lit(100)),
    )
