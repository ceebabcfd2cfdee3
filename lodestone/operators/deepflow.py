"""Taint within Java methods: statements in single-assignment form, a lattice of taint, and what flows into dangerous calls.

A method is read line by line.  Each line that assigns, returns, writes a
field or calls becomes a statement; each definition of a variable is a new
version of it, and what a statement uses are versions.  Values carry a level,
the sources they come from, a path and the sinks they were cleaned for;
statements are applied in order to the state of the versions.

Methods whose parameters an annotation marks as given by a request are
analysed; calls pass no taint on to other methods.  A method depends on
nothing outside it, so files are read in parallel, in one vectorised pass
without a shuffle.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.javacode import Java, Method, parts
from lodestone.functions.text import mapped
from lodestone.operators.findings import shaped
from lodestone.operators.sanitizers import COMMAND, DESERIALIZATION, FILE, LDAP, LOG, PRESERVING, SINKS, SQL, SSRF, XPATH, XSS, Registry

# Methods that give tainted values, annotations of tainted parameters, and dangerous methods.
SOURCES = {
    "getParameter": "http_parameter", "getQueryString": "http_parameter", "getParameterValues": "http_parameter", "getParameterMap": "http_parameter",
    "getHeader": "http_header", "getHeaders": "http_header", "getCookies": "cookie", "getCookie": "cookie",
    "getInputStream": "http_body", "getReader": "http_body", "getRequestBody": "http_body", "getBody": "http_body",
    "getPathInfo": "path_variable", "getRequestURI": "path_variable", "getRequestURL": "path_variable", "getServletPath": "path_variable",
    "readLine": "file_input", "readAllLines": "file_input", "readAllBytes": "file_input", "read": "file_input",
    "getenv": "environment", "getProperty": "environment", "getString": "database", "getObject": "database", "nextLine": "user_input", "next": "user_input",
}
ANNOTATIONS = {
    "@RequestParam": "http_parameter", "@QueryParam": "http_parameter", "@PathVariable": "path_variable", "@PathParam": "path_variable", "@RequestBody": "http_body",
    "@RequestHeader": "http_header", "@HeaderParam": "http_header", "@CookieValue": "cookie", "@CookieParam": "cookie", "@FormParam": "http_parameter", "@MatrixParam": "http_parameter",
}
DANGEROUS = {
    SQL: ("executeQuery", "executeUpdate", "execute", "createQuery", "createNativeQuery", "createSQLQuery", "rawQuery"),
    COMMAND: ("exec", "start", "command"),
    FILE: ("FileInputStream", "FileOutputStream", "FileReader", "FileWriter", "newInputStream", "newOutputStream", "readAllBytes", "readAllLines", "delete", "exists"),
    SSRF: ("openConnection", "openStream", "getForObject", "getForEntity", "postForObject", "postForEntity", "exchange", "retrieve", "newCall"),
    XSS: ("write", "print", "println", "append", "setAttribute"),
    DESERIALIZATION: ("readObject", "readUnshared", "fromJson", "readValue", "unmarshal"),
    LDAP: ("search", "lookup"),
    XPATH: ("evaluate", "selectNodes", "selectSingleNode"),
    LOG: ("info", "debug", "warn", "error", "trace", "log"),
}
SINK_OF = {method: sink for sink, methods in DANGEROUS.items() for method in methods}
# Severity, CWE, OWASP category and title of what reaches a sink.
GRADES = {
    SQL: ("critical", "CWE-89", "A03:2021-Injection", "SQL Injection via Tainted Data"),
    COMMAND: ("critical", "CWE-78", "A03:2021-Injection", "Command Injection via Tainted Data"),
    FILE: ("high", "CWE-22", "A01:2021-Broken Access Control", "Path Traversal via Tainted Data"),
    SSRF: ("high", "CWE-918", "A10:2021-SSRF", "SSRF via Tainted Data"),
    XSS: ("high", "CWE-79", "A03:2021-Injection", "XSS via Tainted Data"),
    DESERIALIZATION: ("critical", "CWE-502", "A08:2021-Software and Data Integrity Failures", "Insecure Deserialization"),
    LDAP: ("high", "CWE-90", "A03:2021-Injection", "LDAP Injection via Tainted Data"),
    XPATH: ("medium", "CWE-643", "A03:2021-Injection", "XPath Injection via Tainted Data"),
    LOG: ("low", "CWE-532", "A09:2021-Security Logging and Monitoring Failures", "Log Injection via Tainted Data"),
}
REMEDIES = {
    SQL: "Bind values as parameters of prepared statements; never put request values into the text of a query.",
    COMMAND: "Keep request values out of commands; where one is needed, allow only listed values and pass arguments as an array without a shell.",
    FILE: "Resolve a path to its canonical form and check that it stays below an allowed folder before it is opened.",
    SSRF: "Allow only listed hosts and protocols, and refuse addresses of internal networks.",
    XSS: "Encode what is written for its place in the page, and send a content security policy.",
    DESERIALIZATION: "Do not deserialize untrusted data; prefer a format with a strict schema.",
    LDAP: "Escape request values in filters, or use parameters.",
    XPATH: "Use precompiled expressions with variables, and escape request values.",
    LOG: "Strip line ends from request values before they are logged, and leave secrets out.",
}

CLEAN, PARTLY, TAINTED = 1, 2, 3


class Label(NamedTuple):
    """Where a value comes from."""

    kind: str
    place: str
    annotation: str
    variable: str


class Value(NamedTuple):
    """A point of the taint lattice."""

    level: int = CLEAN
    labels: frozenset[Label] = frozenset()
    path: tuple[str, ...] = ()
    cleaned: frozenset[str] = frozenset()

    def join(self, other: Value) -> Value:
        """The least upper bound: sources of either, cleaned for what both are, the longer path."""
        if not self.level or not other.level:
            return other if not self.level else self
        longer = self.path if len(self.path) >= len(other.path) else other.path
        return Value(max(self.level, other.level), self.labels | other.labels, longer, self.cleaned & other.cleaned)

    def reaches(self, sink: str) -> bool:
        return self.level >= PARTLY and sink not in self.cleaned

    def cleaned_for(self, sinks: tuple[str, ...]) -> Value:
        cleaned = self.cleaned | frozenset(sinks)
        return self._replace(cleaned=cleaned, level=PARTLY if cleaned >= set(SINKS) else self.level)


NOTHING = Value()

# --- statements

_DECLARED = re.compile(r"(?:final\s+)?(\w+(?:<[^>]+>)?)\s+(\w+)\s*=\s*(.+)")
_PLAIN = re.compile(r"(\w+)\s*=\s*(.+)")
_FIELD = re.compile(r"(\w+)\.(\w+)\s*=\s*(.+)")
_CALL = re.compile(r"(?:(\w+(?:\.\w+)*)\.)?(\w+)\s*\(([^)]*)\)")
_INNER = re.compile(r"(\w+)\s*\(([^)]*)\)")
_NEW = re.compile(r"new\s+(\w+(?:<[^>]+>)?)\s*\(([^)]*)\)")
_NUMBER = re.compile(r"-?\d+(\.\d+)?[LlFfDd]?")
_OPERATORS = (" + ", " - ", " * ", " / ", " && ", " || ", " == ", " != ", " < ", " > ")


class Expression(NamedTuple):
    """literal, variable, binary, call, field, new or unknown; a name, and what it is made of."""

    kind: str
    name: str = ""
    inner: tuple[Expression, ...] = ()  # operands; of a field access its object; of a call its arguments
    receiver: Expression | None = None

    def uses(self) -> list[str]:
        own = [self.name] if self.kind == "variable" else []
        return own + (self.receiver.uses() if self.receiver else []) + [v for x in self.inner for v in x.uses()]


@dataclass
class Statement:
    kind: str  # assignment, return, field_write or call
    line: int
    variable: str | None = None
    version: int | None = None
    value: Expression | None = None
    receiver: str | None = None
    owner: str | None = None
    method: str | None = None
    arguments: tuple[Expression, ...] = ()

    @property
    def defines(self) -> str | None:
        return f"{self.variable}_{self.version}" if self.version else None

    def uses(self) -> list[str]:
        found = ([self.receiver] if self.receiver else []) + (self.value.uses() if self.value else [])
        return found + [v for a in self.arguments for v in a.uses()]


def parameter(text: str) -> tuple[str | None, list[str]]:
    """(name, annotations) of a declared parameter."""
    marks = re.findall(r"@\w+(?:\s*\([^)]*\))?", text)
    words = re.sub(r"@\w+\s*(\([^)]*\))?\s*", "", text).replace("...", "").split()
    return (words[-1] if words else None), marks


class Body:
    """A method's statements in single-assignment form."""

    def __init__(self, parameters: list[str], text: str, start_line: int):
        self.versions: dict[str, int] = {}
        self.parameters = []
        for p in parameters:
            name, marks = parameter(p)
            if name:
                self.parameters.append((name, self._new(name), marks))
        self.statements = [s for k, line in enumerate(text.split("\n")) if (s := self._statement(line.strip(), start_line + k))]

    def _new(self, name: str) -> int:
        self.versions[name] = self.versions.get(name, 0) + 1
        return self.versions[name]

    def _current(self, name: str) -> str | None:
        return f"{name}_{self.versions[name]}" if name in self.versions else None

    def _statement(self, line: str, number: int) -> Statement | None:
        if not line or line.startswith(("//", "/*")):
            return None
        line = line.rstrip(";").strip()
        if line.startswith("return "):
            return Statement("return", number, value=self.expression(line[7:]) if line[7:].strip() else None)
        if m := _DECLARED.match(line):
            return self._assignment(m[2], m[3], number)
        if m := _PLAIN.match(line):
            return self._assignment(m[1], m[2], number)
        if m := _FIELD.match(line):
            value = self.expression(m[3])
            return Statement("field_write", number, variable=m[2], value=value, receiver=self._current(m[1]))
        if "(" in line and not line.startswith(("if", "for")) and (m := _CALL.match(line)):
            static = m[1] is not None and m[1][0].isupper()
            return Statement("call", number, receiver=None if static or not m[1] else self._current(m[1]), owner=m[1] if static else None, method=m[2], arguments=self._arguments(m[3]))
        return None

    def _assignment(self, name: str, value: str, number: int) -> Statement:
        version = self._new(name)  # before the value is read: in x = x + 1 both are the new version
        return Statement("assignment", number, variable=name, version=version, value=self.expression(value))

    def _arguments(self, text: str) -> tuple[Expression, ...]:
        return tuple(self.expression(x) for x in parts(text))

    def expression(self, text: str) -> Expression:
        text = text.strip()
        if text in ("null", "true", "false") or _NUMBER.fullmatch(text) or (text.startswith('"') and text.endswith('"')):
            return Expression("literal")
        if m := _NEW.match(text):
            return Expression("new", m[1], self._arguments(m[2]))
        if "(" in text:
            return self._chain(text)
        if "." in text:
            return Expression("field", text.rsplit(".", 1)[1], receiver=self.expression(text.rsplit(".", 1)[0]))
        for operator in _OPERATORS:
            if operator in text:
                left, right = text.split(operator, 1)
                return Expression("binary", operator.strip(), (self.expression(left), self.expression(right)))
        current = self._current(text)
        return Expression("variable", current) if current else Expression("unknown")

    def _chain(self, text: str) -> Expression:
        """A call after the last dot outside round brackets, else one at the text's beginning."""
        depth, dot = 0, -1
        for i, c in enumerate(text):
            depth += (c == "(") - (c == ")")
            if c == "." and depth == 0:
                dot = i
        if dot > 0 and (m := _INNER.match(text[dot + 1 :])):
            receiver = self.expression(text[:dot])
            return Expression("call", m[1], self._arguments(m[2]), receiver)
        m = _INNER.match(text)
        return Expression("call", m[1], self._arguments(m[2])) if m else Expression("unknown")


# --- transfer


class Flow:
    """Applies a method's statements to a state; gathers (sink, value, line) of dangerous calls that taint reaches."""

    def __init__(self, body: Body, path: str, start_line: int, registry: Registry):
        self.path, self.registry = path, registry
        self.state: dict[str, Value] = {}
        self.fields: dict[tuple[str, str], Value] = {}
        self.collections: dict[str, Value] = {}
        self.returned: Value | None = None
        self.reached: list[tuple[str, Value, int]] = []
        for name, version, marks in body.parameters:
            found = next(((a, kind) for mark in marks for a, kind in ANNOTATIONS.items() if a[1:] in mark), None)
            if found:
                label = Label(found[1], f"{path}:{start_line}", found[0], name)
                self.state[f"{name}_{version}"] = Value(TAINTED, frozenset((label,)), (f"param:{name}",))
        self.starts = bool(self.state)
        self.body = body

    def run(self) -> Flow:
        for s in self.body.statements:
            if s.kind == "assignment":
                self.state[s.defines] = self.value(s.value, s.line)
            elif s.kind == "return" and s.value:
                self.returned = self.value(s.value, s.line)
            elif s.kind == "field_write" and s.receiver:
                self.fields[s.receiver, s.variable] = self.value(s.value, s.line)
            elif s.kind == "call":
                self._call(s)
        return self

    def _call(self, s: Statement) -> None:
        """A cleaning or source call is no sink; a dangerous one counts by its first tainted argument; what is put in a collection taints it."""
        if self.registry.find(s.method, s.owner) or s.method in SOURCES:
            return
        sink = SINK_OF.get(s.method)
        values = [self.value(a, s.line) for a in s.arguments]
        if sink and (hit := next((v for v in values if v.reaches(sink)), None)):
            self.reached.append((sink, hit, s.line))
        if s.method in MUTATORS and s.receiver and values and values[-1].level >= PARTLY:
            self.collections[s.receiver] = self.collections.get(s.receiver, NOTHING).join(values[-1])

    def value(self, x: Expression, line: int) -> Value:
        if x.kind == "variable":
            return self.state.get(x.name, NOTHING)
        if x.kind == "field":
            return self.value(x.receiver, line)
        if x.kind in ("binary", "new"):
            return self._joined(x.inner, line)
        if x.kind != "call":
            return NOTHING
        if x.name in SOURCES:
            return Value(TAINTED, frozenset((Label(SOURCES[x.name], f"{self.path}:{line}", x.name, x.name),)))
        cleaner = self.registry.find(x.name)
        if cleaner and cleaner.returns and x.inner:
            return self.value(x.inner[0], line).cleaned_for(cleaner.cleans)
        if x.name in PRESERVING and x.receiver:
            return self.value(x.receiver, line)
        return self._joined(((x.receiver,) if x.receiver else ()) + x.inner, line)

    def _joined(self, inner: tuple[Expression, ...], line: int) -> Value:
        out = NOTHING
        for x in inner:
            out = out.join(self.value(x, line))
        return out


#: Methods that put their last argument into their object.
MUTATORS = frozenset(("add", "addAll", "put", "putAll", "set", "push", "offer", "addFirst", "addLast"))


def methods_of(content: str) -> Iterator[tuple[Method, Body, int]]:
    """The methods of a file's classes, in order, as statements, with the line each begins in."""
    source = Java(content)
    for one in source.classes():
        for method in one.methods:
            line = source.line_of(method.start)
            yield method, Body(method.parameters, content[method.start : method.end + 1], line), line


_STATEMENTS = "file_path string, class_name string, method_name string, start_line int, seq int, line int, kind string, variable string, version int, method string, uses array<string>"


def statements(files: DataFrame) -> DataFrame:
    """One row per statement in single-assignment form; parameters are version 1 of their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False, name=None):
                for method, body, line in _safely(path, content):
                    rows.extend((path, method.owner, method.name, line, k, s.line, s.kind, s.variable, s.version, s.method, s.uses()) for k, s in enumerate(body.statements))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _STATEMENTS.split(", ")]).astype({"version": "Int64"})

    return files.filter(F.col("ext") == ".java").select("path", "content").mapInPandas(run, _STATEMENTS)


def _safely(path: str, content: str) -> list[tuple[Method, Body, int]]:
    try:
        return list(methods_of(content or ""))
    except Exception:  # one file must not end the analysis of the others
        logging.getLogger(__name__).exception("not analysed: %s", path)
        return []


_VULNERABILITIES = "file_path string, line int, sink_type string, sink_method string, source_type string, source_loc string, variable string, annotation string, path array<string>"


def _reached(path: str, content: str, registry: Registry) -> list[tuple]:
    """Rows of one file, as far as its analysis came."""
    rows, seen = [], set()
    try:
        for method, body, start in _safely(path, content):
            flow = Flow(body, path, start, registry)
            if not flow.starts:
                continue
            for sink, value, line in flow.run().reached:
                for label in sorted(value.labels):
                    if (sink, label.place, line) not in seen:
                        seen.add((sink, label.place, line))
                        rows.append((path, line, sink, method.name, label.kind, label.place, label.variable, label.annotation, list(value.path)))
    except Exception:  # one file must not end the analysis of the others
        logging.getLogger(__name__).exception("not analysed: %s", path)
    return rows


def vulnerabilities(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """One row per sink type, source place and sink place."""
    registry = registry or Registry()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for path, content in batch.itertuples(index=False, name=None) for r in _reached(path, content, registry)]
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in _VULNERABILITIES.split(", ")])

    return files.filter(F.col("ext") == ".java").select("path", "content").mapInPandas(run, _VULNERABILITIES)


def findings(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """DATAFLOW findings of the files."""
    rows, kind = vulnerabilities(files, registry), F.col("sink_type")
    grade = lambda k: mapped(kind, {s: g[k] for s, g in GRADES.items()})
    source = F.concat("source_type", F.lit(" at "), F.col("source_loc"))
    place = F.concat_ws(":", "file_path", F.col("line").cast("string"))
    flow = F.when(F.size("path") > 0, F.concat(F.lit(" Flow path: "), F.array_join("path", " -> "))).otherwise("")
    return shaped(
        rows,
        engine="dataflow",
        engine_seq=10,
        rule_ord=F.array_position(F.array(*map(F.lit, GRADES)), kind),
        pattern_idx=0,
        match_no=F.col("line"),
        line_number=F.col("line"),
        rule_id=F.concat(F.lit("DATAFLOW-"), F.upper(F.translate(kind, "_", "-"))),
        rule_name=grade(3),
        description=F.concat(F.lit("Tainted data from "), source, F.lit(" flows to dangerous "), kind, F.lit(" sink at "), place, F.lit("."), flow),
        severity=grade(0),
        confidence="high",
        snippet=F.concat(F.lit("Source: "), F.col("variable"), F.when(F.col("annotation").isNotNull(), F.concat(F.lit(" ("), F.col("annotation"), F.lit(")"))).otherwise("")),
        cwe=grade(1),
        owasp=grade(2),
        remediation=mapped(kind, REMEDIES),
        tags=F.array(F.lit("dataflow"), F.lit("taint-tracking"), kind),
        metadata=F.create_map(F.lit("source_location"), F.col("source_loc"), F.lit("source_type"), F.col("source_type"), F.lit("propagation_path"), F.array_join("path", "; "), F.lit("analysis_type"), F.lit("deep_dataflow")),
    )


def statistics(files: DataFrame) -> DataFrame:
    """(name, n): methods analysed, vulnerabilities, and those of each sink type."""
    found = vulnerabilities(files)
    seen = statements_of_methods(files)
    by_sink = found.groupBy(F.concat(F.lit("by_sink_type."), F.col("sink_type")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return seen.unionByName(found.agg(F.count(F.lit(1)).alias("n")).select(F.lit("vulnerabilities_found").alias("name"), "n")).unionByName(by_sink)


def statements_of_methods(files: DataFrame) -> DataFrame:
    """(name, n): how many methods the files' classes have."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"n": [sum(len(_safely(p, c)) for p, c in batch.itertuples(index=False, name=None))]})

    counted = files.filter(F.col("ext") == ".java").select("path", "content").mapInPandas(run, "n long")
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("methods_analyzed").alias("name"), "n")
