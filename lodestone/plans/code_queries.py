"""Queries of the analyses that read the structure of code, and the SQL or the expected rows that state the same results.

Extractors and endpoints run on the code corpus, as the driver's tables hold
no source code; what joins, walks or looks up runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import astcheck, deepflow, extract, multilang, sanitizers, spring, types
from lodestone.plans import sqltext as S
from lodestone.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(spark: SparkSession) -> DataFrame:
    return corpus.files(spark, corpus.CODE)


def _both(spark: SparkSession) -> DataFrame:
    return _code(spark).unionByName(corpus.files(spark))


def values(columns: str, rows: list[tuple]) -> str:
    """Rows as SQL."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else S.quoted(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


# --- structure of code: expected rows over the corpus

CONTROLLER, BASE, FILES = "app/web/ReportController.java", "app/web/BaseController.java", "src/main/java/shop/Files.java"


def deep_dataflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deepflow.findings(_both(spark)).select("rule_id", "file_path", "line_number", "severity", "cwe", "snippet")


DEEP_SQL = values("rule_id, file_path, line_number, severity, cwe, snippet", [("DATAFLOW-SQL-QUERY", CONTROLLER, 10, "critical", "CWE-89", "Source: id (@RequestParam)")])


def ssa_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deepflow.statements(_code(spark)).filter(F.col("method_name") == "run").filter(F.col("class_name") == "ReportController")
    return rows.select("line", "kind", "variable", "version", "method", F.array_join("uses", ",").alias("uses"))


SSA_SQL = values(
    "line, kind, variable, version, method, uses",
    [
        (19, "assignment", "body", 2, None, "body_2,times_1"),
        (20, "call", None, None, "exec", "body_2"),
        (21, "assignment", "other", 1, None, "body_2"),
        (22, "call", None, None, "exec", "other_1"),
        (23, "assignment", "all", 1, None, ""),
        (24, "call", None, None, "delete", "all_1"),
    ],
)


def dataflow_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deepflow.statistics(_both(spark))


STATS_SQL = values("name, n", [("methods_analyzed", 14), ("vulnerabilities_found", 1), ("by_sink_type.sql_query", 1)])


def ast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = astcheck.java_findings(_both(spark)).select("rule_id", "file_path", "line_number", "severity", "confidence", "cwe")
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


AST_SQL = values(
    "rule_id, file_path, line_number, severity, confidence, cwe, n",
    [
        ("AST-SQL_INJECTION-001", CONTROLLER, 29, "high", "medium", "CWE-89", 2),
        ("AST-COMMAND_INJECTION-001", CONTROLLER, 29, "high", "medium", "CWE-78", 1),
        ("AST-XSS-001", CONTROLLER, 30, "high", "medium", "CWE-79", 1),
        ("AST-SSRF-001", CONTROLLER, 31, "high", "medium", "CWE-918", 1),
        ("AST-COMMAND_INJECTION-001", FILES, 7, "high", "medium", "CWE-78", 2),
    ],
)


def go_ast_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return astcheck.go_findings(_both(spark)).select("rule_id", "file_path", "line_number", "severity", "confidence", "cwe", "owasp")


GO_SQL = values(
    "rule_id, file_path, line_number, severity, confidence, cwe, owasp",
    [
        ("GO-SQLI-001", "svc/handler.go", 8, "high", "medium", "CWE-89", "A03"),
        ("GO-CMDI-001", "svc/handler.go", 9, "critical", "medium", "CWE-78", "A03"),
        ("GO-SSRF-001", "svc/handler.go", 11, "high", "medium", "CWE-918", "A10"),
        ("GO-SQLI-001", "svc/main.go", 4, "high", "medium", "CWE-89", "A03"),
    ],
)


def java_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.classes(_code(spark)).select("class_name", "extends", F.array_join("implements", ",").alias("implements"), "file_path", "line")


TYPES_SQL = values(
    "class_name, extends, implements, file_path, line",
    [("ReportController", "BaseController", "Reports,Audited", CONTROLLER, 3), ("BaseController", "Root", "Closeable", BASE, 2), ("Inner", None, "", BASE, 5), ("Root", None, "", BASE, 7)],
)


def java_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.signatures(_code(spark)).select("class_name", "method_name", F.array_join("params", ",").alias("params"), "return_type", "line", "is_static", "is_abstract")


SIGNATURES_SQL = values(
    "class_name, method_name, params, return_type, line, is_static, is_abstract",
    [
        ("ReportController", "report", "String,String", "String", 7, False, False),
        ("ReportController", "run", "String,int", "void", 17, False, False),
        ("ReportController", "plain", "HttpServletRequest", "void", 27, False, False),
        ("BaseController", "close", "int", "void", 3, False, True),
        ("BaseController", "run", "String", "void", 4, False, False),
        ("Inner", "go", "List<String>,Integer>", "String", 5, False, False),
        ("Root", "plain", "", "void", 7, False, False),
    ],
)


def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return astcheck.script_calls(_code(spark)).select("file_path", "function", "line", F.array_join("arguments", "|").alias("arguments"))


SCRIPT_SQL = values(
    "file_path, function, line, arguments",
    [
        ("web/urls.py", "path", 3, "'orders/'|views.orders"), ("web/urls.py", "path", 4, '"orders/<int:pk>/"|views.order'), ("web/flaskapp.py", "Flask", 2, "__name__"),
        ("web/flaskapp.py", "app.route", 3, "'/login'"), ("web/flaskapp.py", "app.route", 5, '"/items/<id>"'), ("site/pages/api/users.js", "res.end", 1, ""),
    ],
)


def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return astcheck.python_functions(_code(spark)).select("file_path", "name", "first_line", "last_line", F.array_join("parameters", ",").alias("parameters"))


FUNCTIONS_SQL = values("file_path, name, first_line, last_line, parameters", [("web/flaskapp.py", "login", 4, 4, ""), ("web/flaskapp.py", "item", 6, 6, "id")])


# --- extractors, endpoints and signs


def _extracted(language: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(_both(spark), language).select("file_path", "kind", "match_no", "line_number", "text")


def _extract_sql(language: str) -> str:
    extensions, patterns = extract.LANGUAGES[language]
    gate = f"ext IN ({', '.join(map(S.quoted, extensions))})"
    source = f"SELECT path, content FROM ({corpus.sql({**corpus.CODE, **corpus.FILES})}) WHERE {gate}"
    one = lambda kind, p: f"SELECT path AS file_path, '{kind}' AS kind, CAST(i AS INTEGER) AS match_no, line AS line_number, matched AS text FROM ({S.matches(source, S.quoted(p))})"
    return "\nUNION ALL\n".join(one(kind, p) for kind, p in patterns.items())


def extracted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, objects and arguments of everything but strings in one file of each language."""
    parts = [extract.extracted(_code(spark), language) for language in extract.LANGUAGES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("kind IN ('class', 'function')").select("file_path", "kind", "name", "line_number")


NAMES_SQL = values(
    "file_path, kind, name, line_number",
    [
        ("svc/handler.go", "class", "Server", 3), ("svc/handler.go", "function", "find", 7), ("svc/Repo.cs", "class", "Repo", 1), ("svc/Repo.cs", "function", "Count", 2),
        ("svc/Main.kt", "class", "Main", 1), ("svc/Main.kt", "class", "Single", 4), ("svc/Main.kt", "function", "start", 2), ("svc/cart.php", "class", "Cart", 2), ("svc/cart.php", "function", "add", 3),
        ("svc/order.rb", "class", "Order", 1), ("svc/order.rb", "function", "total", 2), ("svc/store.rs", "class", "Store", 1), ("svc/store.rs", "function", "open", 3),
        ("svc/Item.swift", "class", "Item", 1), ("svc/Item.swift", "class", "Basket", 2), ("svc/Item.swift", "function", "add", 2),
    ],
)


def framework_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.endpoints(_code(spark))


ENDPOINTS_SQL = values(
    "framework, url, http_method, handler, file_path, line_number",
    [
        ("django", "orders/", "GET", "", "web/urls.py", 3), ("django", "orders/<int:pk>/", "GET", "", "web/urls.py", 4), ("flask", "/login", "GET", "", "web/flaskapp.py", 3), ("flask", "/items/<id>", "GET", "", "web/flaskapp.py", 5),
        ("react", "users.js", "POST", "users", "site/pages/api/users.js", 1), ("react", "health.ts", "GET", "health", "site/app/api/health.ts", 1), ("react", "health.ts", "POST", "health", "site/app/api/health.ts", 1),
    ],
)


def framework_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.security_settings(_code(spark))


SETTINGS_SQL = f"""
SELECT 'django' AS framework, 'DEBUG' AS name, 'true' AS value, path AS file_path, CAST(length(b) - length(replace(b, chr(10), '')) + 1 AS INTEGER) AS line_number, false AS is_secure, 'Set DEBUG = False in production' AS recommendation
FROM (SELECT path, content, left(content, strpos(content, 'DEBUG = True') - 1) AS b FROM ({corpus.sql(corpus.CODE)}) WHERE contains(path, 'settings.py') AND contains(content, 'DEBUG = True'))
UNION ALL SELECT 'react', 'security_headers', NULL, path, 1, false, 'Add security headers in next.config.js' FROM ({corpus.sql(corpus.CODE)}) WHERE contains(path, 'next.config') AND NOT contains(content, 'headers')"""
SIGNS = {"next": ["package:next", "file:next.config.js"], "flask": [r"import:from\s+flask"], "rails": ["file:gemfile"], "spring": ["content:@RestController"], "none": ["package:left-pad"]}


def framework_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.detected(_code(spark), SIGNS)


SIGNS_SQL = f"""
SELECT unnest(['next', 'flask', 'rails', 'spring', 'none']) AS framework, unnest([bool_or((contains(path, 'package.json') AND contains(content, '"next"')) OR lower(name) = 'next.config.js'), bool_or(regexp_matches(content, 'from\\s+flask')),
  bool_or(lower(name) = 'gemfile'), bool_or(contains(content, '@RestController')), bool_or(contains(path, 'package.json') AND contains(content, '"left-pad"'))]) AS present FROM ({corpus.sql(corpus.CODE)})"""


def spring_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spring.is_project(corpus.files(spark))


SPRING_GATE_SQL = f"""
WITH k AS (SELECT * FROM ({corpus.sql()}) WHERE ext IN ('.java', '.yml', '.yaml', '.properties'))
SELECT coalesce((SELECT bool_or(regexp_matches(name, 'Controller|Config|Repository|Service') OR name IN ('application.yml', 'application.yaml', 'application.properties')) FROM k), false)
    OR coalesce((SELECT bool_or(regexp_matches(content, '@Controller|@RestController|@SpringBootApplication|@Service')) FROM (SELECT * FROM k ORDER BY path LIMIT 10)), false) AS spring"""


# --- joins and walks over whole tables


def sanitizer_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made from lineitem, looked up."""
    of = lambda options, c: F.element_at(F.array(*map(F.lit, options)), (c + 1).cast("int"))
    calls = _table(spark, sf_dir, "lineitem").select(
        of(_METHODS, F.col("l_partkey") % len(_METHODS)).alias("method"), of(_OWNERS, F.col("l_suppkey") % len(_OWNERS)).alias("owner"), of(_PACKAGES, F.col("l_orderkey") % len(_PACKAGES)).alias("package")
    )
    found = sanitizers.looked_up(calls, sanitizers.Registry().table(spark))
    return found.groupBy("method", "owner", "package", "is_sanitizer", "sanitizer_owner", F.array_join("cleans", ",").alias("cleans"), "argument").agg(F.count(F.lit(1)).alias("n"))


_METHODS = ["escape", "quote", "valueOf", "encode", "clean", "setString", "h", "HtmlEncode", "parse", "strip_tags", "normalize"]
_OWNERS = ["CGI", "java.lang.Integer", "Encoder", "html", "path", None, "StringEscapeUtils", "PreparedStatement"]
_PACKAGES = [None, "java.lang", "org.owasp.encoder", "Microsoft.Security.Application", "java.sql"]


def _sanitizers_sql() -> str:
    rows, k = [], 0
    grouped: dict[str, list] = {}
    for s in sanitizers.BUILT_IN:
        grouped.setdefault(s.method, []).append(s)
    for of in grouped.values():
        for s in of:
            rows.append((k, s.method, s.owner, s.package, ",".join(s.cleans), s.argument))
            k += 1
    pick = lambda options, c: f"[{', '.join('NULL' if o is None else S.quoted(o) for o in options)}][1 + {c} % {len(options)}]"
    return f"""
WITH s AS ({values("priority, s_method, s_owner, s_package, cleans, argument", rows)}),
c AS (SELECT row_number() OVER () AS k, {pick(_METHODS, "l_partkey")} AS method, {pick(_OWNERS, "l_suppkey")} AS owner, {pick(_PACKAGES, "l_orderkey")} AS package FROM lineitem),
j AS (SELECT c.*, s.* FROM c LEFT JOIN s ON method = s_method AND (s_owner IS NULL OR contains(owner, s_owner)) AND (s_package IS NULL OR package IS NULL OR regexp_matches(package, '^(?:' || s_package || ')'))
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY priority) = 1)
SELECT method, owner, package, s_method IS NOT NULL AS is_sanitizer, s_owner AS sanitizer_owner, cleans, CAST(argument AS INTEGER) AS argument, count(*) AS n FROM j GROUP BY ALL"""


def multilang_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda options, c: F.element_at(F.array(*map(F.lit, options)), (c + 1).cast("int"))
    calls = _table(spark, sf_dir, "lineitem").select(of(_LANGUAGES, F.col("l_partkey") % len(_LANGUAGES)).alias("language"), of(_NAMES, F.col("l_suppkey") % len(_NAMES)).alias("method"))
    found = multilang.looked_up(calls)
    return found.groupBy("language", "method", "source", "sink", F.array_join("cleans", ",").alias("cleans"), "annotation").agg(F.count(F.lit(1)).alias("n"))


_LANGUAGES = ["go", "CS", "kotlin", "php", "rb", "rust", "Swift", "cobol"]
_NAMES = ["Query", "exec", "escape", "Clean", "params", "readObject", "query", "print", "[FromBody]", "execute", "h", "parse", "ReadLine"]


def _multilang_sql() -> str:
    rows = []
    for language in multilang.languages():
        given, reached, cleaned, marked = multilang.sources(language), multilang.sinks(language), multilang.sanitizers(language), multilang.annotations(language)
        for method in sorted({*given, *reached, *cleaned, *marked}):
            rows.append((language, method, given.get(method), reached.get(method), ",".join(sorted(cleaned.get(method, ()))), marked.get(method)))
    pick = lambda options, c: f"[{', '.join(map(S.quoted, options))}][1 + {c} % {len(options)}]"
    return f"""
WITH t AS ({values("l, m, source, sink, cleans, annotation", rows)}),
c AS (SELECT {pick(_LANGUAGES, "l_partkey")} AS language, {pick(_NAMES, "l_suppkey")} AS method FROM lineitem)
SELECT language, method, source, sink, coalesce(cleans, '') AS cleans, annotation, count(*) AS n
FROM c LEFT JOIN t ON l = CASE lower(language) WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' ELSE lower(language) END AND m = method GROUP BY ALL"""


def _part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy of as many classes as parts: each extends that of half its number."""
    n = F.col("p_partkey")
    named = lambda c: F.concat(F.lit("C"), c.cast("string"))
    half = F.floor(n / 2)
    return _table(spark, sf_dir, "part").select(named(n).alias("class_name"), F.when(half > 0, named(half)).alias("extends"), F.array(F.concat(F.lit("I"), (F.col("p_size") % 7).cast("string"))).alias("implements"))


def type_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.chains(_part_classes(spark, sf_dir))


_UP = "WITH RECURSIVE w(c, a, d) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT c, a // 2, d + 1 FROM w WHERE a // 2 > 0)"
CHAINS_SQL = f"""
{_UP} SELECT 'C' || c AS class_name, 'C' || a AS ancestor, CAST(d AS INTEGER) AS depth FROM w
UNION ALL SELECT 'C' || c, 'Object', CAST(max(d) + 1 AS INTEGER) FROM w GROUP BY c"""


def type_interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.interfaces(_part_classes(spark, sf_dir))


INTERFACES_SQL = f"{_UP} SELECT DISTINCT 'C' || c AS class_name, 'I' || (p_size % 7) AS interface FROM w JOIN part ON p_partkey = a"


def type_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many subtypes each type has."""
    return types.subtypes(_part_classes(spark, sf_dir)).groupBy("supertype").agg(F.count(F.lit(1)).alias("n"))


SUBTYPES_SQL = f"""
{_UP} SELECT supertype, count(DISTINCT c) AS n FROM (
  SELECT c, 'C' || a AS supertype FROM w UNION ALL SELECT p_partkey, 'Object' FROM part UNION ALL SELECT c, 'I' || (p_size % 7) FROM w JOIN part ON p_partkey = a) GROUP BY 1"""


def _methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method per line of an order, in the class of its part."""
    text = lambda c: c.cast("string")
    return _table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("C"), text(F.col("l_partkey"))).alias("class_name"),
        F.concat(F.lit("m"), text(F.col("l_orderkey") % 997)).alias("method_name"),
        F.array_repeat(F.lit("int"), (F.col("l_suppkey") % 4).cast("int")).alias("params"),
        F.concat(F.lit("f"), text(F.col("l_orderkey"))).alias("file_path"),
        F.col("l_linenumber").alias("line"),
    )


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_orderkey")
    receiver = F.when(order % 3 == 0, F.concat(F.lit("C"), (F.col("o_custkey") + 1).cast("string"))).when(order % 3 == 1, F.concat(F.lit("I"), (order % 7).cast("string")))
    return _table(spark, sf_dir, "orders").select(order.alias("call_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 997).cast("string")).alias("method_name"), receiver.alias("receiver_type"), (order % 3).cast("int").alias("n_args"))


_METHODS_SQL = "SELECT 'C' || l_partkey AS class_name, 'm' || (l_orderkey % 997) AS method_name, CAST(l_suppkey % 4 AS INTEGER) AS n_params, 'f' || l_orderkey AS file_path, l_linenumber AS line FROM lineitem"
_CALLS_SQL = "SELECT o_orderkey AS call_id, 'm' || (o_custkey % 997) AS method_name, CASE o_orderkey % 3 WHEN 0 THEN 'C' || (o_custkey + 1) WHEN 1 THEN 'I' || (o_orderkey % 7) END AS receiver_type, CAST(o_orderkey % 3 AS INTEGER) AS n_args FROM orders"


def type_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many methods each call may mean."""
    return types.target_counts(_calls(spark, sf_dir), _part_classes(spark, sf_dir), _methods(spark, sf_dir))


TARGETS_SQL = f"""
{_UP}, m AS ({_METHODS_SQL}), c0 AS ({_CALLS_SQL}),
s AS (SELECT 'C' || c AS type, 'C' || a AS class_name FROM w UNION SELECT 'I' || (p_size % 7), 'C' || p_partkey FROM part),
f AS (SELECT DISTINCT call_id, m.class_name, file_path, line FROM c0 JOIN s ON receiver_type = type JOIN m ON m.class_name = s.class_name AND m.method_name = c0.method_name
      UNION SELECT DISTINCT call_id, class_name, file_path, line FROM c0 JOIN m USING (method_name) WHERE receiver_type IS NULL)
SELECT call_id, count(*) AS n, min(class_name) AS first_class FROM f GROUP BY 1"""


def named_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = types.named_targets(_calls(spark, sf_dir), _methods(spark, sf_dir))
    return found.groupBy("call_id").agg(F.count(F.lit(1)).cast("long").alias("n"), F.min_by("file_path", "place").alias("first_file"))


NAMED_SQL = f"""
WITH m AS ({_METHODS_SQL}), c AS ({_CALLS_SQL}),
r AS (SELECT call_id, file_path, row_number() OVER (PARTITION BY call_id ORDER BY file_path, line, class_name) AS place FROM c JOIN m USING (method_name) WHERE n_params >= n_args)
SELECT call_id, count(*) AS n, arg_min(file_path, place) AS first_file FROM r WHERE place <= 5 GROUP BY 1"""


def type_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    return types.guess_types(names, _part_classes(spark, sf_dir).filter(F.col("extends").isNotNull()))


GUESS_SQL = "SELECT 'c' || c_custkey AS name, CASE WHEN c_custkey IN (SELECT p_partkey FROM part WHERE p_partkey > 1) THEN 'C' || c_custkey END AS type FROM customer"
_EXPRESSIONS = ['new ArrayList<String>(', '"text"', "12", "-7L", "1.5", "2.5f", "true", "call(1)", "null", "new  Foo (1)"]


def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, _EXPRESSIONS)), (F.col("event_id") % len(_EXPRESSIONS) + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select(text.alias("expression"))
    return rows.groupBy("expression", types.inferred(F.col("expression")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


INFERENCE_SQL = f"""
WITH e AS (SELECT [{', '.join(map(S.quoted, _EXPRESSIONS))}][1 + event_id % {len(_EXPRESSIONS)}] AS expression FROM events)
SELECT expression, CASE expression WHEN 'new ArrayList<String>(' THEN 'ArrayList' WHEN '"text"' THEN 'String' WHEN '12' THEN 'int' WHEN '-7L' THEN 'long' WHEN '1.5' THEN 'double' WHEN '2.5f' THEN 'float'
  WHEN 'true' THEN 'boolean' WHEN 'new  Foo (1)' THEN 'Foo' END AS type, count(*) AS n FROM e GROUP BY ALL"""

_PLAIN: dict[str, tuple[Query, str]] = {
    "deep_dataflow": (deep_dataflow, DEEP_SQL), "ssa_statements": (ssa_statements, SSA_SQL), "dataflow_stats": (dataflow_stats, STATS_SQL), "ast_findings": (ast_findings, AST_SQL), "go_ast_findings": (go_ast_findings, GO_SQL),
    "script_calls": (script_calls, SCRIPT_SQL), "python_functions": (python_functions, FUNCTIONS_SQL), "java_types": (java_types, TYPES_SQL), "java_signatures": (java_signatures, SIGNATURES_SQL), "extracted_names": (extracted_names, NAMES_SQL), "framework_endpoints": (framework_endpoints, ENDPOINTS_SQL),
    "framework_settings": (framework_settings, SETTINGS_SQL), "framework_signs": (framework_signs, SIGNS_SQL), "spring_gate": (spring_gate, SPRING_GATE_SQL), "sanitizer_lookup": (sanitizer_lookup, _sanitizers_sql()),
    "multilang_lookup": (multilang_lookup, _multilang_sql()), "type_chains": (type_chains, CHAINS_SQL), "type_interfaces": (type_interfaces, INTERFACES_SQL), "type_subtypes": (type_subtypes, SUBTYPES_SQL),
    "type_targets": (type_targets, TARGETS_SQL), "named_targets": (named_targets, NAMED_SQL), "type_guess": (type_guess, GUESS_SQL), "type_inference": (type_inference, INFERENCE_SQL),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _PLAIN.items()} | {f"lang_extract_{x}": partial(_extracted, x) for x in extract.LANGUAGES}


def oracle_sql() -> dict[str, str]:
    # Ruby's call pattern looks ahead, which DuckDB's expressions cannot
    return {k: sql for k, (_, sql) in _PLAIN.items()} | {f"lang_extract_{x}": _extract_sql(x) for x in extract.LANGUAGES if x != "ruby"}
