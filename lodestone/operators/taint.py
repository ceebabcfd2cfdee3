"""Taint from request values to dangerous calls, within methods and along the call graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import java
from lodestone.operators.callgraph import CUT_ROUNDS, calls, containing, methods, resolved
from lodestone.operators.findings import shaped
from lodestone.operators.labelflow import label_sets
from lodestone.operators.lineage import cut

# Patterns of sources and sinks, and the grades of what they make.
JAVA_SOURCES = {
    "http_parameter": [r"@RequestParam\s+\w+\s+(\w+)", r"@QueryParam\s+\w+\s+(\w+)", r"request\.getParameter\s*\(\s*[\"\'](\w+)[\"\']\s*\)", r"getParameter\s*\(\s*[\"\'](\w+)[\"\']\s*\)"],
    "path_variable": [r"@PathVariable\s+(?:\w+\s+)?(\w+)", r"@PathParam\s+(?:\w+\s+)?(\w+)"],
    "http_body": [r"@RequestBody\s+\w+\s+(\w+)"],
    "http_header": [r"@RequestHeader\s+(?:\w+\s+)?(\w+)", r"request\.getHeader\s*\(\s*[\"\'](\w+)[\"\']\s*\)"],
    "cookie": [r"@CookieValue\s+(?:\w+\s+)?(\w+)", r"request\.getCookies\s*\(\s*\)()"],
}
PYTHON_SOURCES = {
    "http_parameter": [r"request\.args\.get\s*\(\s*[\"\'](\w+)[\"\']\s*\)", r"request\.GET\.get\s*\(\s*[\"\'](\w+)[\"\']\s*\)", r"request\.form\.get\s*\(\s*[\"\'](\w+)[\"\']\s*\)", r"request\.POST\.get\s*\(\s*[\"\'](\w+)[\"\']\s*\)"],
    "http_body": [r"request\.json()", r"request\.data()", r"request\.body()"],
    "path_variable": [r"def\s+\w+\s*\([^)]*(\w+)[^)]*\):"],
}
JAVA_SINKS = {
    "sql_query": [r"executeQuery\s*\(", r"executeUpdate\s*\(", r"createNativeQuery\s*\(", r"createQuery\s*\(", r"jdbcTemplate\.\w+\s*\(", r"\$\{[^}]+\}"],
    "command_exec": [r"Runtime\.getRuntime\(\)\.exec\s*\(", r"ProcessBuilder\s*\(", r"\.exec\s*\("],
    "file_access": [r"new\s+File\s*\(", r"new\s+FileInputStream\s*\(", r"new\s+FileOutputStream\s*\(", r"Files\.read", r"Files\.write", r"Paths\.get\s*\("],
    "ssrf": [r"new\s+URL\s*\(", r"openConnection\s*\(", r"RestTemplate.*\.\w+\s*\(", r"WebClient.*\.uri\s*\(", r"HttpClient.*\.send\s*\("],
    "xss": [r"response\.getWriter\(\)\.(print|write)\s*\(", r"\.innerHTML\s*=", r"document\.write\s*\("],
    "deserialization": [r"ObjectInputStream\s*\(", r"\.readObject\s*\(", r"XMLDecoder\s*\("],
    "log_output": [r"logger\.(info|debug|warn|error)\s*\(", r"log\.(info|debug|warn|error)\s*\("],
}
GRADES = {
    "sql_query": ("SQL Injection", "CWE-89", "A03"), "command_exec": ("Command Injection", "CWE-78", "A03"), "file_access": ("Path Traversal", "CWE-22", "A01"),
    "ssrf": ("Server-Side Request Forgery", "CWE-918", "A10"), "xss": ("Cross-Site Scripting", "CWE-79", "A03"), "deserialization": ("Insecure Deserialization", "CWE-502", "A08"),
    "log_output": ("Sensitive Data Logging", "CWE-532", "A09"),
}
#: Lines before a sink, and the one after it, in which a value may flow into it.
BEFORE, AFTER = 4, 1


def _hits(files: DataFrame, extensions: tuple[str, ...], of_line) -> DataFrame:
    """(file_path, *struct) of what of_line gives for a file's lines, their numbers and all its lines: only hits become rows."""
    lines = F.split("content", "\n", -1)
    found = F.flatten(F.transform(F.col("lines"), lambda text, i: of_line(text, i + 1)))
    rows = files.filter(F.col("ext").isin(*extensions)).select(F.col("path").alias("file_path"), lines.alias("lines"))
    return rows.select("file_path", F.explode(found).alias("h")).select("file_path", "h.*")


def _any(patterns: list[str]) -> str:
    return java("|".join(f"(?:{p})" for p in patterns))


def sources(files: DataFrame) -> DataFrame:
    """(file_path, line, var, source_type): values that a request gives."""
    out = None
    for extension, table in ((".java", JAVA_SOURCES), (".py", PYTHON_SOURCES)):

        def of_line(text: Column, number: Column, table: dict = table) -> Column:
            found = []
            for kind, patterns in table.items():
                for p in patterns:
                    name = F.regexp_extract(text, java(p), 1)
                    var = F.when(name == "", "unknown").otherwise(name)
                    found.append(F.when(text.rlike(java(p)), F.struct(number.alias("line"), var.alias("var"), F.lit(kind).alias("source_type"))))
            some = F.filter(F.array(*found), lambda x: x.isNotNull())
            return F.when(text.rlike(_any([p for patterns in table.values() for p in patterns])), some).otherwise(F.array().cast("array<struct<line:int,var:string,source_type:string>>"))

        rows = _hits(files, (extension,), of_line)
        out = rows if out is None else out.unionByName(rows)
    return out


def sinks(files: DataFrame) -> DataFrame:
    """(file_path, line, sink_type, sink_code, near): dangerous calls, one of a type a line, with the lines around them."""

    def of_line(text: Column, number: Column) -> Column:
        first = F.greatest(number - BEFORE, F.lit(1))
        near = F.array_join(F.slice("lines", first, number + AFTER + 1 - first), "\n")
        found = [
            F.when(text.rlike(_any(patterns)), F.struct(number.alias("line"), F.lit(kind).alias("sink_type"), F.trim(text).alias("sink_code"), near.alias("near")))
            for kind, patterns in JAVA_SINKS.items()
        ]
        some = F.filter(F.array(*found), lambda x: x.isNotNull())
        return F.when(text.rlike(_any([p for patterns in JAVA_SINKS.values() for p in patterns])), some).otherwise(F.array().cast("array<struct<line:int,sink_type:string,sink_code:string,near:string>>"))

    return _hits(files, (".java",), of_line)


def propagated(seeds: DataFrame, sites: DataFrame) -> DataFrame:
    """(uid, var, source_type, source_loc, path) of tainted values: seeds, and the parameters that tainted arguments reach.

    seeds: the same columns.  sites: (caller_uid, callee_uid, args).  A value
    that an argument's text holds taints the callee's parameter of that
    position, named param_0 and so on, once, by the shortest and then least
    path.  Rounds end when nothing is new.
    """
    known = cut(seeds.select("uid", "var", "source_type", "source_loc", "path"))
    frontier = known
    arguments = cut(sites.select(F.col("caller_uid").alias("uid"), "callee_uid", F.posexplode("args").alias("k", "arg")))
    for k in count(1):
        step = frontier.join(arguments, "uid").filter(F.col("arg").contains(F.col("var")))
        link = F.concat(F.col("uid"), F.lit(" -> "), F.col("callee_uid"))
        step = step.select(F.col("callee_uid").alias("uid"), F.concat(F.lit("param_"), F.col("k").cast("string")).alias("var"), "source_type", "source_loc", F.concat("path", F.array(link)).alias("path"))
        best = step.groupBy("uid", "var").agg(F.min(F.struct(F.size("path").alias("n"), "path", "source_type", "source_loc")).alias("b"))
        new = best.join(known.select("uid", "var").distinct(), ["uid", "var"], "left_anti").select("uid", "var", "b.source_type", "b.source_loc", "b.path")
        frontier = cut(new)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
        if k % CUT_ROUNDS == 0:
            known = cut(known)
    return known


def value_edges(seeds: DataFrame, sites: DataFrame) -> DataFrame:
    """(a, b): from a value, a struct of uid and var, to the parameter that an argument holding it gives.

    Values are the seeds' (uid, var) and every parameter that a call gives.
    """
    arguments = cut(sites.select(F.col("caller_uid").alias("uid"), "callee_uid", F.posexplode("args").alias("k", "arg")))
    given = F.concat(F.lit("param_"), F.col("k").cast("string"))
    values = seeds.select("uid", "var").unionByName(arguments.select(F.col("callee_uid").alias("uid"), given.alias("var"))).distinct()
    held = arguments.join(values, "uid").filter(F.col("arg").contains(F.col("var")))
    return held.select(F.struct("uid", "var").alias("a"), F.struct(F.col("callee_uid").alias("uid"), given.alias("var")).alias("b")).distinct()


def source_sets(seeds: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All sources that reach each value: sets (uid, var, word, bits) over the sources' places, and their numbers.

    propagated() keeps one source and a path for each value; here none is lost.
    """
    sets, names = label_sets(seeds.select(F.struct("uid", "var").alias("node"), F.col("source_loc").alias("label")), value_edges(seeds, sites))
    return sets.select("node.uid", "node.var", "word", "bits"), names


def flows(tainted: DataFrame, reached: DataFrame) -> DataFrame:
    """Sinks joined to the tainted values of their method that they hold, or that the lines around put into an expression."""
    v = F.concat(F.lit(r"\Q"), F.col("var"), F.lit(r"\E"))
    near = lambda before, after: F.call_function("regexp_like", F.col("near"), F.concat(F.lit(before), v, F.lit(after)))
    indirect = near("", r"\s*\+") | near(r"\+\s*", "") | near(r"\$\{", r"\}") | near("%s.*", "") | near("", r"\)")
    return reached.join(tainted, "uid").filter(F.col("sink_code").contains(F.col("var")) | indirect)


def findings(files: DataFrame) -> DataFrame:
    """DATAFLOW findings of the files."""
    found = cut(methods(files))
    sites = cut(calls(files, found))
    links = sites.join(resolved(sites, found), "call_id").select("caller_uid", "callee_uid", "args")
    given = containing(sources(files), found).filter("uid IS NOT NULL")
    seeds = given.select("uid", "var", "source_type", F.concat_ws(":", "file_path", F.col("line").cast("string")).alias("source_loc"), F.array().cast("array<string>").alias("path"))
    reached = containing(sinks(files), found).filter("uid IS NOT NULL")
    rows = flows(propagated(seeds, links), reached)
    order = list(JAVA_SINKS)
    grade = lambda k: F.element_at(F.create_map(*[F.lit(x) for kind, g in GRADES.items() for x in (kind, g[k])]), F.col("sink_type"))
    kind, source = F.col("sink_type"), F.col("source_type")
    chain = F.when(F.size("path") > 0, F.array_join("path", " -> ")).otherwise("direct")
    return shaped(
        rows.withColumn("line_number", F.col("line")),
        engine="dataflow",
        engine_seq=10,
        rule_ord=F.array_position(F.array(*map(F.lit, order)), kind),
        pattern_idx=F.size("path"),
        match_no=F.col("line"),
        rule_id=F.concat(F.lit("DATAFLOW-"), F.upper(kind)),
        rule_name=F.concat(grade(0), F.lit(" via "), source),
        description=F.concat(F.lit("Tainted data from "), source, F.lit(" ("), F.col("var"), F.lit(") flows to "), kind, F.lit(" sink. Flow: "), chain),
        severity=F.when(kind.isin("sql_query", "command_exec"), "high").otherwise("medium"),
        confidence="high",
        snippet=F.left("sink_code", F.lit(200)),
        cwe=grade(1),
        owasp=grade(2),
        tags=F.array(F.lit("dataflow"), kind, source),
        remediation=F.concat(F.lit("Sanitize or validate the "), source, F.lit(" input before using in "), kind),
        metadata=F.create_map(F.lit("source_type"), source, F.lit("source_loc"), F.col("source_loc"), F.lit("path"), F.array_join("path", "; ")),
    )
