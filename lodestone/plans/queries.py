"""Every operator as a query, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.regex import java, matches
from lodestone.operators import callgraph, checks, enrich, graph, impact, labelflow, lattice, manypatterns, mybatis, onepass, patterns, priority, snippets, spring, tablefunctions, taint
from lodestone.operators import context as ctx
from lodestone.operators import findings as relation
from lodestone.operators.check_tables import ANGULAR, CLOUDFORMATION, DJANGO, FLASK, FRAMEWORKS, LANGUAGES, REACT, VUE
from lodestone.operators.lineage import shuffled
from lodestone.plans import code_queries, reports
from lodestone.plans import sqltext as S
from lodestone.plans.scan import Scan
from lodestone.sources import corpus, files, rules
from lodestone.streaming.incremental import windowed_metrics

Query = Callable[[SparkSession, str], DataFrame]
SECRET = r'(?:token|key|secret)\s*=\s*"[^"]{16,}"'
CHECK_COLUMNS = ("file_path", "rule_id", "pattern_idx", "match_no", "line_number", "severity", "confidence", "cwe", "owasp")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under made-up paths."""
    doc = F.col("doc_id")
    folder = F.when(doc % 7 == 0, "test/").when(doc % 11 == 0, "vendor/").when(doc % 13 == 0, "node_modules/").otherwise("")
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("lang") == "fr", ".java").when(F.col("lang") == "de", ".txt").otherwise(".yml")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), folder, F.lit("doc_"), doc.cast("string"), ext)
    return files.from_table(_table(spark, sf_dir, "documents").select(path.alias("path"), F.col("text").alias("content")))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made from lineitem."""
    of = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    rule = F.col("l_suppkey") % 5
    rows = _table(spark, sf_dir, "lineitem").select(
        of(["SQLI-001", "XSS-002", "LOG-001", "CMD-001", "SECRET-003"], rule).alias("rule_id"), of(["critical", "high", "medium", "low", "info"], F.col("l_partkey") % 5).alias("severity"),
        of(["high", "medium", "low"], F.col("l_orderkey") % 3).alias("confidence"), F.concat(F.lit("src/f"), (F.col("l_orderkey") % 97).cast("string"), F.lit(".java")).alias("file_path"),
        F.col("l_quantity").cast("int").alias("line_number"), of(["CWE-89", "CWE-79", None, "CWE-78", "CWE-798"], rule).alias("cwe"), of(["A03", "A03", "A09", None, "A07"], rule).alias("owasp"),
        F.col("l_linenumber").cast("int").alias("engine_seq"), F.col("l_partkey").cast("int").alias("rule_ord"), F.col("l_suppkey").cast("int").alias("pattern_idx"), F.col("l_orderkey").cast("int").alias("match_no"),
    )
    return relation.shaped(rows)


def _corpus(spark: SparkSession) -> DataFrame:
    return corpus.files(spark)


def _rules(spark: SparkSession) -> DataFrame:
    return rules.from_rows(spark, corpus.RULES)


# --- documents as files


def secret_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir).select("path", F.posexplode(matches(F.col("content"), java(SECRET))).alias("i", "m"))
    return rows.select("path", (F.col("i") + 1).cast("int").alias("match_no"), F.col("m.line").alias("line_number"), F.col("m.matched").alias("matched"))


SECRET_SQL = f"SELECT path, CAST(i AS INTEGER) AS match_no, line AS line_number, matched FROM ({S.matches(S.PATHS, S.quoted(SECRET))})"
ENTROPY_SQL = "list_sum(list_transform(list_distinct(string_split({0}, '')), lambda c: -((length({0}) - length(replace({0}, c, ''))) / length({0})) * log2((length({0}) - length(replace({0}, c, ''))) / length({0}))))"


def secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = T.assigned_value(F.col("matched"))
    rows = secret_matches(spark, sf_dir).withColumn("value", value)
    return rows.select("path", "match_no", F.length("value").alias("n"), F.round(T.entropy(F.col("value")), 6).alias("entropy"), T.likely_secret(F.col("value")).alias("likely"))


SECRET_ENTROPY_SQL = f"""
WITH s AS ({SECRET_SQL}), v AS (SELECT path, match_no, trim(regexp_extract(matched, '=(.*)$', 1), ' "') AS value FROM s),
e AS (SELECT path, match_no, value, {ENTROPY_SQL.format("value")} AS h FROM v)
SELECT path, match_no, CAST(length(value) AS INTEGER) AS n, round(h, 6) AS entropy,
       length(value) >= 8 AND NOT list_bool_or(list_transform({S.lit(T.NOT_SECRET)}, lambda w: contains(lower(value), w))) AND (length(value) < 20 OR h >= 3.5) AS likely
FROM e"""


def file_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _paths(spark, sf_dir)
    return rows.select("path", "ext", files.selected(F.col("path"), F.col("size"), excludes=["doc_1*", "src3/"]).alias("selected"))


FILE_FILTER_SQL = f"""
WITH p AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) AS ext, octet_length(encode(content)) AS size FROM ({S.PATHS}))
SELECT path, ext, (list_contains({S.lit(files.EXTENSIONS)}, ext) OR list_contains({S.lit(files.NAMES)}, name)) AND size <= 10485760 AND NOT list_contains({S.lit(files.SKIP_NAMES)}, name)
       AND NOT list_has_any(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), {S.lit(files.SKIP_DIRECTORIES)}) AND NOT contains(path, 'doc_1') AND NOT contains(path, '/src3/') AS selected FROM p"""


def file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctx.file_context(_paths(spark, sf_dir).unionByName(_corpus(spark))).drop("framework")


def _any_sql(column: str, patterns_: list[str]) -> str:
    return f"regexp_matches({column}, {S.quoted('(?i)(?:' + ')|(?:'.join(patterns_) + ')')})"


FILE_CONTEXT_SQL = f"""
WITH f AS (SELECT path, content FROM ({S.PATHS}) UNION ALL SELECT path, content FROM ({corpus.sql()})),
g AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM f), h AS (SELECT *, lower(regexp_extract(name, '^.+(\\.[^.]+)$', 1)) AS ext FROM g)
SELECT path, {_any_sql("path", ctx.TEST_PATHS)} AS is_test, {_any_sql("path", ctx.EXAMPLE_PATHS)} AS is_example, name IN ({", ".join(map(S.quoted, ctx.CONFIG_NAMES))}) AS is_config,
       content <> '' AND {_any_sql("left(content, 2000)", ctx.GENERATED_TEXTS)} AS is_generated, {_any_sql("path", ctx.VENDOR_PATHS)} AS is_vendor,
       CASE ext {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.CONTEXT_LANGUAGES.items())} ELSE 'unknown' END AS language
FROM h"""


def numbered_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_matches(spark, sf_dir).withColumnRenamed("path", "file_path")
    return snippets.with_snippets(found, _paths(spark, sf_dir), 2, "snippet").select(F.col("file_path").alias("path"), "match_no", "snippet")


SNIPPET_SQL = f"""
WITH s AS ({SECRET_SQL}), j AS (SELECT s.path, match_no, line_number AS n, string_split(content, chr(10)) AS l FROM s JOIN ({S.PATHS}) p USING (path))
SELECT path, match_no, array_to_string(list_transform(range(greatest(n - 2, 1), least(n + 2, len(l)) + 1), lambda i: (CASE WHEN i = n THEN '>>>' ELSE '   ' END) || ' ' || lpad(CAST(i AS VARCHAR), 4, ' ') || ' | ' || l[i]), chr(10)) AS snippet FROM j"""


def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    return _table(spark, sf_dir, "pages").select("page_id", count("<script").alias("scripts"), count("(?s)<!--.*?-->").alias("comments"), count('href="[^"]*"').alias("links"), count("(?i)javascript:").alias("script_links"))


PAGE_SQL = """
SELECT page_id, len(regexp_extract_all(html, '<script')) AS scripts, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS comments, len(regexp_extract_all(html, 'href="[^"]*"')) AS links,
       len(regexp_extract_all(html, '(?i)javascript:')) AS script_links FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)"""


# --- rules over the corpus


def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.chosen(_rules(spark), languages=["Java"], severity_min="medium").select("rule_id", "severity", F.size("patterns").alias("n_patterns"))


def _rules_sql() -> str:
    parsed = [r for r in map(rules.parsed, corpus.RULES) if r]
    row = lambda i, r: f"({i}, {S.quoted(r[1])}, {S.quoted(r[4])}, {S.quoted(r[7])}, {S.lit(r[9])}::VARCHAR[], {S.lit(r[10])}::VARCHAR[], {len(r[12])}, {str(r[16]).lower()})"
    return f"SELECT * FROM (VALUES {', '.join(row(i, r) for i, r in enumerate(parsed))}) AS r(rule_ord, rule_id, severity, owasp, tags, languages, n_patterns, enabled)"


RULE_FILTER_SQL = f"SELECT rule_id, severity, n_patterns FROM ({_rules_sql()}) WHERE enabled AND (len(languages) = 0 OR list_contains(languages, 'java')) AND {S.RANK} >= 3"
RULE_STATS_SQL = f"""
SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (n_patterns = 0) AS dead, {", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in T.SEVERITIES)} FROM ({_rules_sql()})"""
RULES_BY_OWASP_SQL = f"SELECT coalesce(owasp, 'Other') AS owasp, count(*) AS n, array_to_string(list_sort(list(rule_id)), ',') AS rules FROM ({_rules_sql()}) GROUP BY 1"


def rules_by_owasp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.by_owasp(_rules(spark)).select("owasp", "n", F.array_join(F.transform("rules", lambda r: r["rule_id"]), ",").alias("rules"))


def rule_file_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patterns.match_rules(_corpus(spark), _rules(spark), context_aware=False)
    return found.select("file_path", "rule_id", "pattern_idx", "match_no", "line_number", "snippet", "matched_pattern")


def _rule_sql() -> str:
    parts = []
    for doc in corpus.RULES:
        r = rules.parsed(doc)
        if not r or not r[16]:
            continue
        rule_id, tags, languages, globs, found = r[1], r[9], r[10], r[11], r[12]
        suffixes = [s for x in languages for s in rules.RULE_SUFFIXES.get(x, ())]
        gate = " OR ".join([f"name GLOB {S.quoted(g)}" for g in globs] + ([f"ext IN ({', '.join(map(S.quoted, suffixes))})"] if suffixes else [])) or "TRUE"
        for k, (p, language, _, _, missing, ignore_case) in enumerate(found):
            more = f" AND ext = '.py'" if language == "python" else ""  # noqa: F541
            for alternative in (missing or "").split("|"):
                more += f" AND NOT regexp_matches(content, {S.quoted('(?i)' + alternative)})" if alternative else ""
            source = f"SELECT path, content FROM ({corpus.sql()}) WHERE ({gate}){more}"
            keep = "(named IS NULL OR (named <> '' AND NOT list_contains(list_transform(string_split(named, ','), lambda x: trim(x)), " + S.quoted(rule_id) + ")))"
            if {"secret", "credentials"} & set(tags):
                value = "trim(trim(regexp_extract(left(matched, 100), '=(.*)$', 1)), '\"''')"
                words = f"list_bool_or(list_transform({S.lit(T.NOT_SECRET)}, lambda w: contains(lower({value}), w)))"
                keep += f" AND length({value}) >= 8 AND NOT {words} AND (length({value}) < 20 OR {ENTROPY_SQL.format(value)} >= 3.5)"
            line = "string_split(content, chr(10))[line]"
            named = f"CASE WHEN regexp_matches({line}, '(?i)(?:#|//|/\\*)\\s*nosec\\b') THEN trim(regexp_extract({line}, '(?i)(?:#|//|/\\*)\\s*nosec\\b\\s*([\\w,\\s-]*)', 1)) END"
            inner = S.matches(source, S.pattern(p, "im" if ignore_case else "m"))
            parts.append(
                f"SELECT path AS file_path, {S.quoted(rule_id)} AS rule_id, {k} AS pattern_idx, CAST(i AS INTEGER) AS match_no, line AS line_number, left(trim(text), 200) AS snippet, left(matched, 100) AS matched_pattern "
                f"FROM (SELECT *, {line} AS text, {named} AS named FROM ({inner})) WHERE {keep}"
            )
    return "\nUNION ALL\n".join(parts)


def contextual(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _corpus(spark)
    return ctx.with_context(onepass.scan(source, _rules(spark).filter("enabled"), ("rules",)), source).select("file_path", "rule_id", "line_number", "severity", "confidence")


def _checked(engine: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = {"language": "languages", "framework": "frameworks", "iac": "iac"}[engine.split(":")[0]]
    return onepass.scan(_corpus(spark), _rules(spark), (kind,)).filter(F.col("engine") == engine).select(*CHECK_COLUMNS)


def _extensions(extensions: tuple[str, ...]) -> str:
    return f"ext IN ({', '.join(map(S.quoted, extensions))}) AND content <> ''"


def _php_sql() -> str:
    use = S.quoted(r"(?:exec|shell_exec|system|passthru|popen)\s*\(\s*\$(\w+)\s*\)")
    inner = S.matches(f"SELECT path, content FROM ({corpus.sql()}) WHERE {_extensions(LANGUAGES['php'][0])}", use)
    return (
        f"SELECT path AS file_path, 'PHP-CMDI-001' AS rule_id, 2 AS pattern_idx, CAST(i AS INTEGER) AS match_no, line AS line_number, 'critical' AS severity, 'high' AS confidence, 'CWE-78' AS cwe, 'A03' AS owasp FROM ({inner}) "
        f"WHERE list_contains(regexp_extract_all(content, '\\$(\\w+)\\s*=\\s*\\$_(?:GET|POST|REQUEST|COOKIE|SERVER)', 1), regexp_extract(matched, {use}, 1))"
    )


def framework_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.frameworks(_corpus(spark))


def spring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("SPRING-SEC-001", "SPRING-SEC-002", "SPRING-SEC-003", "SPRING-SEC-004", "SPRING-CFG-001", "SPRING-CFG-002", "SPRING-CFG-003")
    return spring.findings(_corpus(spark)).filter(F.col("rule_id").isin(*kinds)).select("file_path", "rule_id", "line_number", "severity", "confidence", "snippet")


def _spring_sql() -> str:
    config = "ext = '.java' AND (contains(content, 'SecurityFilterChain') OR contains(content, 'WebSecurityConfigurerAdapter'))"
    settings = "ext IN ('.yml', '.yaml', '.properties')"
    table = (
        ("SPRING-SEC-001", "high", "high", config, spring.CSRF_OFF), ("SPRING-SEC-002", "medium", "high", config, spring.CORS_ALL), ("SPRING-SEC-003", "critical", "high", config, spring.PERMIT_ALL),
        ("SPRING-SEC-004", "medium", "high", config, spring.NO_FIXATION), ("SPRING-CFG-001", "high", "high", settings, spring.ACTUATOR), ("SPRING-CFG-002", "medium", "medium", settings, spring.DEBUG), ("SPRING-CFG-003", "medium", "high", settings, spring.HTTP_ONLY_OFF),
    )
    lines = f"SELECT path, ext, content, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM ({corpus.sql()})"
    one = lambda r: f"SELECT path AS file_path, '{r[0]}' AS rule_id, CAST(n AS INTEGER) AS line_number, '{r[1]}' AS severity, '{r[2]}' AS confidence, trim(text) AS snippet FROM ({lines}) WHERE {r[3]} AND ({' OR '.join(f'regexp_matches(text, {S.quoted(p)})' for p in r[4])})"
    return "\nUNION ALL\n".join(map(one, table))


def iac_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = _corpus(spark)
    return relation.union_all(*[checks.iac_resources(source, k) for k in ("terraform", "dockerfile", "cloudformation")])


def _resources_sql() -> str:
    tf, docker, cfn = r'resource\s*"([^"]+)"\s*"([^"]+)"', r"FROM\s+(\S+)", r"""(\w+):\s*\n\s*Type:\s*["\']?(AWS::[^\s"\']+)"""
    rows = lambda where, p: S.matches(f"SELECT path, content FROM ({corpus.sql()}) WHERE {where}", S.quoted(p))
    part = lambda p, k: f"regexp_extract(matched, {S.quoted(p)}, {k})"
    provider = "CASE WHEN starts_with(t, 'aws_') THEN 'aws' WHEN regexp_matches(t, '^(?:google|gcp)_') THEN 'gcp' WHEN starts_with(t, 'azurerm_') THEN 'azure' ELSE 'unknown' END"
    return f"""
SELECT t AS resource_type, n AS name, path AS file_path, line AS line_number, {provider} AS provider FROM (SELECT *, {part(tf, 1)} AS t, {part(tf, 2)} AS n FROM ({rows("ext IN ('.tf', '.tfvars')", tf)}))
UNION ALL SELECT 'base_image', {part(docker, 1)}, path, line, 'docker' FROM ({rows("starts_with(lower(name), 'dockerfile')", docker)})
UNION ALL SELECT {part(cfn, 2)}, {part(cfn, 1)}, path, line, 'aws' FROM ({rows("ext IN ('.yaml', '.yml', '.json')", cfn)})"""


# --- the findings relation


def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation.deduplicated(_findings(spark, sf_dir)).select("rule_id", "file_path", "line_number", "engine_seq", "rule_ord", "pattern_idx", "match_no")


DEDUPE_SQL = f"""
SELECT rule_id, file_path, line_number, engine_seq, rule_ord, pattern_idx, match_no FROM ({S.FINDINGS})
QUALIFY row_number() OVER (PARTITION BY rule_id, file_path, line_number ORDER BY engine_seq, rule_ord, pattern_idx, match_no) = 1"""


def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation.conditional_counts(_findings(spark, sf_dir), F.col("file_path").isin("src/f1.java", "src/f2.java"))


def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.csv_table(relation.deduplicated(_findings(spark, sf_dir))).select("finding_id", "rule_id", "severity", "file_path", "line_number", "cwe")


CSV_SQL = f"""
WITH d AS (SELECT * FROM ({S.FINDINGS}) QUALIFY row_number() OVER (PARTITION BY rule_id, file_path, line_number ORDER BY engine_seq, rule_ord, pattern_idx, match_no) = 1)
SELECT printf('F%04d', row_number() OVER (ORDER BY {S.RANK} DESC, file_path, line_number, engine_seq, rule_ord, pattern_idx, match_no)) AS finding_id, rule_id, severity, file_path, line_number, cwe FROM d"""


def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(relation.deduplicated(_findings(spark, sf_dir))).select("rule_id", F.col("rule_index").cast("int").alias("rule_index"), "level")


SARIF_SQL = f"""
WITH d AS (SELECT * FROM ({S.FINDINGS}) QUALIFY row_number() OVER (PARTITION BY rule_id, file_path, line_number ORDER BY engine_seq, rule_ord, pattern_idx, match_no) = 1),
n AS (SELECT *, row_number() OVER (ORDER BY {S.RANK} DESC, file_path, line_number, engine_seq, rule_ord, pattern_idx, match_no) AS k FROM d),
f AS (SELECT rule_id, min(k) AS k, arg_min(severity, k) AS severity FROM n GROUP BY 1)
SELECT rule_id, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM f"""


def result_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = relation.at_least(_findings(spark, sf_dir), "high", "medium").filter(F.col("cwe") == "CWE-89")
    return relation.in_files(kept, "f7.java").select("rule_id", "severity", "confidence", "line_number", "match_no", "engine_seq")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = spark.createDataFrame([("src/f3.java",), ("f4.java",)], "path string")
    return files.changed(_findings(spark, sf_dir), changed).groupBy("file_path", "severity").agg(F.count(F.lit(1)).alias("n"))


PRIORITY_SQL = f"""
SELECT *, CASE WHEN priority_score >= 80 THEN 'CRITICAL' WHEN priority_score >= 60 THEN 'HIGH' WHEN priority_score >= 40 THEN 'MEDIUM' WHEN priority_score >= 20 THEN 'LOW' ELSE 'INFO' END AS risk_level
FROM (SELECT *, round(CAST(CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 WHEN 'low' THEN 25 ELSE 10 END AS DOUBLE)
   * (0.4 + 0.6 * CAST(CASE owasp WHEN 'A03' THEN 9 WHEN 'A09' THEN 4 WHEN 'A07' THEN 8 ELSE 5 END AS DOUBLE) / 10)
   * CAST(CASE cwe WHEN 'CWE-89' THEN 1.5 WHEN 'CWE-79' THEN 1.2 WHEN 'CWE-78' THEN 1.5 WHEN 'CWE-798' THEN 1.4 ELSE 1.0 END AS DOUBLE), 6) AS priority_score FROM ({S.FINDINGS}))"""
_TIES = ("file_path", "line_number", "engine_seq", "rule_ord", "pattern_idx", "match_no")


def prioritize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.prioritized(_findings(spark, sf_dir)).groupBy("severity", "owasp", "cwe").agg(F.count(F.lit(1)).alias("n"), F.max("priority_score").alias("priority_score"), F.max("risk_level").alias("risk_level"))


def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.top(_findings(spark, sf_dir), 25, *_TIES).select("rule_id", "priority_score", *_TIES)


def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.within_budget(_findings(spark, sf_dir), 2.0, *_TIES).select("rule_id", "priority_score", *_TIES)


def running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priority.running_cost(_findings(spark, sf_dir), "file_path", *_TIES[1:]).select("file_path", "match_no", "engine_seq", "rule_ord", "running_cost")


def impact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.when(F.col("rule_id") == "LOG-001", F.array(F.lit("app-config"))).otherwise(F.array().cast("array<string>"))
    return impact.with_impact(_findings(spark, sf_dir).withColumn("tags", tags)).groupBy("rule_id", "severity", "impact").agg(F.count(F.lit(1)).alias("n"))


IMPACT_SQL = f"""
WITH t(k, o, text) AS (VALUES {", ".join(f"({S.quoted(k)}, {i}, {S.quoted(v)})" for i, (k, v) in enumerate(impact.BY_TAG.items()))})
SELECT rule_id, severity, coalesce(CASE {" ".join(f"WHEN cwe = {S.quoted(k)} THEN {S.quoted(v)}" for k, v in impact.BY_CWE.items())} END,
       CASE WHEN rule_id = 'LOG-001' THEN (SELECT text FROM t WHERE contains('app-config', k) OR contains(k, 'app-config') ORDER BY o LIMIT 1) END,
       CASE severity {" ".join(f"WHEN {S.quoted(k)} THEN {S.quoted(v)}" for k, v in impact.BY_SEVERITY.items())} END) AS impact, count(*) AS n FROM ({S.FINDINGS}) GROUP BY ALL"""


#: Beginnings of words that patterns look for, made from the letters' pairs.
_PAIRS = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or")
MANY_PATTERNS = [f"(?i)(?:^|[ \n]){a}{b}{c}[a-z]*[ ,.\n]" for a in _PAIRS for b in _PAIRS for c in _PAIRS[:2]]


def many_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of 450 patterns matches in all documents, and in how many."""
    wanted = [manypatterns.Pattern(k, p, 0) for k, p in enumerate(MANY_PATTERNS)]
    found = manypatterns.matched(_table(spark, sf_dir, "documents"), wanted)
    return found.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_docs"))


_PAIRS_SQL = "[" + ", ".join(S.quoted(x) for x in _PAIRS) + "]"
MANY_SQL = f"""
WITH s AS (SELECT {_PAIRS_SQL} AS s), p AS (SELECT i * 30 + j * 2 + k AS pattern, '(?i)(?:^|[ \n])' || s[i + 1] || s[j + 1] || s[k + 1] || '[a-z]*[ ,.\n]' AS p FROM s, range(15) a(i), range(15) b(j), range(2) c(k)),
f AS (SELECT pattern, doc_id, len(regexp_extract_all(text, p)) AS n FROM documents, p)
SELECT CAST(pattern AS INTEGER) AS pattern, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs FROM f WHERE n > 0 GROUP BY 1"""


def analyzer_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's analyzer of files, from SQL over all documents."""
    tablefunctions.register(spark, "long_lines", tablefunctions.of_files(tablefunctions.long_lines, ("doc_id",)))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return spark.sql("SELECT doc_id, line_number, description FROM long_lines(TABLE({docs}))", docs=docs)


ANALYZER_SQL = """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), n AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS line_number, length(l[i]) || ' characters' AS description FROM n WHERE length(l[i]) > 400"""


# --- graphs, taint and the lattice


def asof_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).cast("string").alias("file_path"), (F.col("p_size") * 3).cast("int").alias("start_line")).agg(F.min("p_partkey").cast("string").alias("uid"))
    events = _table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 40).cast("string").alias("file_path"), (F.col("l_quantity") * 3 - 1).cast("int").alias("line"))
    return callgraph.containing(events, heads).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))


ASOF_SQL = """
WITH h AS (SELECT CAST(p_partkey % 40 AS VARCHAR) AS file_path, CAST(p_size * 3 AS INTEGER) AS start_line, CAST(min(p_partkey) AS VARCHAR) AS uid FROM part GROUP BY 1, 2),
e AS (SELECT CAST(l_partkey % 40 AS VARCHAR) AS file_path, CAST(l_quantity * 3 - 1 AS INTEGER) AS line FROM lineitem)
SELECT uid, count(*) AS n FROM e ASOF LEFT JOIN h ON e.file_path = h.file_path AND e.line >= h.start_line GROUP BY 1"""


def _halves(spark: SparkSession, sf_dir: str, *divisors: int) -> DataFrame:
    """Parts as methods, each calling those of a half, a third and so on of its number."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    calls = F.filter(F.array(*[F.floor(F.col("p") / d) for d in divisors]), lambda x: x > 0)
    return part.select(F.col("p").cast("string").alias("caller_uid"), F.explode(calls).alias("c")).select("caller_uid", F.col("c").cast("string").alias("callee_uid"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the largest size, as methods that a request reaches."""
    return _table(spark, sf_dir, "part").filter("p_size = 50").select(F.col("p_partkey").cast("string").alias("s"))


def call_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = callgraph.reached(_halves(spark, sf_dir, 2, 3), _entries(spark, sf_dir))
    return found.select("start", "node", F.col("depth").cast("int").alias("depth"), F.array_join("path", ">").alias("path"))


CHAINS_SQL = """
WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS a, unnest([p_partkey // 2, p_partkey // 3]) AS b FROM part), w(start, node, depth, path) AS (
  SELECT p_partkey, p_partkey, 0, [CAST(p_partkey AS VARCHAR)] FROM part WHERE p_size = 50
  UNION ALL SELECT w.start, e.b, w.depth + 1, list_append(w.path, CAST(e.b AS VARCHAR)) FROM w JOIN e ON e.a = w.node WHERE w.depth < 10 AND e.b > 0)
SELECT CAST(start AS VARCHAR) AS start, CAST(node AS VARCHAR) AS node, CAST(min(depth) AS INTEGER) AS depth, array_to_string(arg_min(path, (depth, path)), '>') AS path FROM w GROUP BY w.start, w.node"""


def superclass_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hierarchy = _halves(spark, sf_dir, 2).select(F.col("caller_uid").alias("child"), F.col("callee_uid").alias("parent"))
    return callgraph.superclasses(hierarchy, _entries(spark, sf_dir)).select("start", "node", F.col("depth").cast("int").alias("depth"))


SUPERCLASS_SQL = """
WITH RECURSIVE w(start, node, depth) AS (SELECT p_partkey, p_partkey // 2, 1 FROM part WHERE p_size = 50 AND p_partkey > 1 UNION ALL SELECT start, node // 2, depth + 1 FROM w WHERE node // 2 > 0)
SELECT CAST(start AS VARCHAR) AS start, CAST(node AS VARCHAR) AS node, CAST(depth AS INTEGER) AS depth FROM w"""


def _looping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods: each calls that of half its number, and some call far ones, which makes loops of many sizes."""
    p = F.col("p_partkey")
    part = _table(spark, sf_dir, "part").select(p)
    far = F.when(p % 50 == 1, p * 13 + 5).when(p % 10 == 7, p * 2)
    far = part.select(p, far.alias("q")).join(shuffled(part.select(p.alias("q"))), "q", "left_semi")
    down = part.select(p, F.floor(p / 2).alias("q")).filter("q > 0")
    return down.unionByName(far).select(p.cast("string").alias("caller_uid"), F.col("q").cast("string").alias("callee_uid"))


_LOOPING_SQL = """
e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey // 2 > 0
      UNION SELECT p.p_partkey, q.p_partkey FROM part p JOIN part q ON q.p_partkey = CASE WHEN p.p_partkey % 50 = 1 THEN p.p_partkey * 13 + 5 WHEN p.p_partkey % 10 = 7 THEN p.p_partkey * 2 END)"""


def call_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many methods each entry reaches, itself included, and the least of them by name."""
    found = graph.reachable(_looping(spark, sf_dir), _entries(spark, sf_dir))
    return found.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))


REACH_SQL = f"""
WITH RECURSIVE {_LOOPING_SQL}, w(start, node) AS (SELECT p_partkey, p_partkey FROM part WHERE p_size = 50 UNION SELECT w.start, e.b FROM w JOIN e ON e.a = w.node)
SELECT CAST(start AS VARCHAR) AS start, count(*) AS n, min(CAST(node AS VARCHAR)) AS least FROM w GROUP BY w.start"""


def call_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of methods that call each other in loops, with the least of each by name and their size."""
    of = graph.components(_looping(spark, sf_dir))
    return of.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


COMPONENTS_SQL = f"""
WITH RECURSIVE {_LOOPING_SQL}, w(start, node) AS (SELECT a, b FROM e UNION SELECT w.start, e.b FROM w JOIN e ON e.a = w.node),
grouped AS (SELECT x.start, min(CAST(x.node AS VARCHAR)) AS component FROM w x JOIN w y ON y.start = x.node AND y.node = x.start GROUP BY x.start)
SELECT component, count(*) AS n FROM grouped GROUP BY component HAVING count(*) > 1"""


def taint_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources reach each value over calls with loops, and the first of them."""
    seeds = _entries(spark, sf_dir).select(F.col("s").alias("uid"), F.lit("x").alias("var"), F.concat(F.lit("f:"), "s").alias("source_loc"))
    n = F.col("caller_uid").cast("long")
    args = F.array(F.concat(F.lit("x + param_"), (n % 2).cast("string")), F.concat(F.lit("param_"), (n % 3 % 2).cast("string")))
    sets, names = taint.source_sets(seeds, _looping(spark, sf_dir).withColumn("args", args))
    sets = sets.select(F.struct("uid", "var").alias("node"), "word", "bits")
    first = labelflow.listed(sets, names).groupBy("node").agg(F.min("label").alias("first_source"))
    return labelflow.counted(sets).join(first, "node").select("node.uid", "node.var", "n", "first_source")


SOURCES_SQL = f"""
WITH RECURSIVE {_LOOPING_SQL}, s AS (SELECT a, b, ['x + param_' || (a % 2), 'param_' || (a % 3 % 2)] AS args FROM e),
w(uid, var, label) AS (
  SELECT p_partkey, 'x', 'f:' || p_partkey FROM part WHERE p_size = 50
  UNION SELECT s.b, 'param_' || (k - 1), w.label FROM w JOIN s ON s.a = w.uid, range(1, len(s.args) + 1) AS t(k) WHERE contains(s.args[k], w.var))
SELECT CAST(uid AS VARCHAR) AS uid, var, count(*) AS n, min(label) AS first_source FROM w GROUP BY 1, 2"""


def taint_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    seeds = entries.select(F.col("s").alias("uid"), F.lit("x").alias("var"), F.lit("http_parameter").alias("source_type"), F.concat(F.lit("f:"), "s").alias("source_loc"), F.array().cast("array<string>").alias("path"))
    p, size = F.col("p_partkey"), F.col("p_size")
    args = F.array(F.concat(F.lit("x + param_"), (p % 2).cast("string")), F.concat(F.lit("param_"), (size % 2).cast("string")))
    sites = _table(spark, sf_dir, "part").filter("p_partkey > 1").select(p.cast("string").alias("caller_uid"), F.floor(p / 2).cast("string").alias("callee_uid"), args.alias("args"))
    return taint.propagated(seeds, sites).select("uid", "var", F.size("path").alias("hops"))


TAINT_SQL = """
WITH RECURSIVE s AS (SELECT p_partkey AS a, p_partkey // 2 AS b, ['x + param_' || (p_partkey % 2), 'param_' || (p_size % 2)] AS args FROM part WHERE p_partkey > 1),
w(uid, var, hops) AS (
  SELECT p_partkey, 'x', 0 FROM part WHERE p_size = 50
  UNION SELECT s.b, 'param_' || (k - 1), w.hops + 1 FROM w JOIN s ON s.a = w.uid, range(1, len(s.args) + 1) AS t(k) WHERE contains(s.args[k], w.var))
SELECT CAST(uid AS VARCHAR) AS uid, var, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY 1, 2"""


def lattice_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    labels = lambda c: F.array_distinct(F.array(F.concat(F.lit("l"), (c % 3).cast("string")), F.concat(F.lit("l"), (c % 5).cast("string"))))
    side = lambda c: lattice.value(c % 5, labels(c), F.array(F.concat(F.lit("s"), (c % 2).cast("string"))))
    a, b = side(n), side(F.col("user_id"))
    rows = _table(spark, sf_dir, "events").select("event_id", lattice.join(a, b).alias("j"), lattice.meet(a, b).alias("m"), lattice.below(a, b).alias("below"))
    show = lambda c: F.concat_ws("|", F.col(f"{c}.level").cast("string"), F.array_join(f"{c}.labels", ","), F.array_join(f"{c}.sanitized_for", ","))
    return rows.select("event_id", show("j").alias("joined"), show("m").alias("met"), "below")


def _lattice_sql() -> str:
    labels = lambda c: f"list_sort(list_distinct(['l' || ({c} % 3), 'l' || ({c} % 5)]))"
    text = lambda level, labels_, cleared: f"concat_ws('|', CAST({level} AS VARCHAR), array_to_string(list_sort({labels_}), ','), array_to_string(list_sort({cleared}), ','))"
    union, common = "list_distinct(list_concat({0}, {1}))", "list_intersect({0}, {1})"
    return f"""
WITH v AS (SELECT event_id, CAST(event_id % 5 AS INTEGER) AS x, CAST(user_id % 5 AS INTEGER) AS y, {labels("event_id")} AS p, {labels("user_id")} AS q, ['s' || (event_id % 2)] AS c, ['s' || (user_id % 2)] AS d FROM events)
SELECT event_id,
  CASE WHEN x = 0 THEN {text("y", "q", "d")} WHEN y = 0 THEN {text("x", "p", "c")} ELSE {text("greatest(x, y)", union.format("p", "q"), common.format("c", "d"))} END AS joined,
  CASE WHEN x = 4 THEN {text("y", "q", "d")} WHEN y = 4 THEN {text("x", "p", "c")} ELSE {text("least(x, y)", common.format("p", "q"), union.format("c", "d"))} END AS met,
  x = 0 OR y = 4 OR (x <= y AND list_has_all(q, p)) AS below FROM v"""


# --- metrics and the rest


# --- expected rows over the corpus, where SQL has not the patterns or the structure

_ORDERS, _MAPPER = "src/main/java/shop/OrderController.java", "src/main/resources/mappers/OrderMapper.xml"
ENDPOINTS_SQL = code_queries.values(
    "path, line_number, class_name, method_name, http_method, url, params, has_authentication, has_validation, snippet",
    [
        (_ORDERS, 7, "OrderController", "one", "GET", "/orders/{id}", "@PathVariable Long id", False, False, '@GetMapping("/{id}")'),
        (_ORDERS, 10, "OrderController", "add", "POST", "/orders", "@RequestBody OrderForm form", False, False, "@PostMapping"),
        (_ORDERS, 18, "OrderController", "drop", "DELETE", "/orders/{id}", "@PathVariable Long id", True, False, '@DeleteMapping("/{id}")'),
    ],
)


def _expected(rows: list[tuple]) -> str:
    return code_queries.values(", ".join(CHECK_COLUMNS), rows)


MAPPER_SQL = _expected([(_MAPPER, f"MYBATIS-{r}", i, n, line, severity, confidence, "CWE-89", "A03") for r, i, n, line, severity, confidence in (
    ("001", 0, 0, 7, "critical", "high"), ("001", 0, 0, 11, "high", "high"), ("001", 0, 0, 14, "high", "medium"), ("001", 0, 1, 14, "high", "medium"), ("001", 0, 0, 19, "high", "medium"),
    ("002", 1, 0, 14, "high", "medium"), ("003", 2, 0, 14, "high", "medium"), ("004", 3, 0, 11, "critical", "high"),
)])
KUBERNETES_SQL = _expected([("ops/pod.yaml", f"K8S-{r}", 0, 1, line, severity, "high", cwe, "A05") for r, line, severity, cwe in (
    ("PRIVILEG", 11, "critical", "CWE-250"), ("NO_RESOU", 8, "medium", "CWE-770"), ("HOST_NET", 7, "high", "CWE-284"), ("DEFAULT_", 5, "low", "CWE-1188"), ("LATEST_I", 9, "low", "CWE-1104"),
)])
DOCKERFILE_SQL = _expected([("ops/Dockerfile", f"DOCKER-{r}", 0, 1, line, severity, "high", cwe, "A05") for r, line, severity, cwe in (
    ("ROOT-001", 1, "high", "CWE-250"), ("LATEST", 1, "medium", "CWE-1104"), ("HARDCO", 2, "critical", "CWE-798"), ("EXPOSE", 5, "medium", "CWE-284"), ("APT_NO", 3, "low", "CWE-1188"), ("CURL_B", 4, "high", "CWE-494"),
)])


def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"))


def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_metrics(_table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


def rules_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _rules(spark)
    return table.join(table.filter(rules.is_secret(F.col("tags"))).select("rule_id"), "rule_id", "left_anti").select("rule_id")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spring.findings(_corpus(spark))
    return enrich.enhanced(enrich.answered(enrich.prompts(found, _corpus(spark)), enrich.stub_provider)).select("rule_id", "file_path", "line_number", "adjusted_severity", "cached", "parse_error")


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scan().run(_corpus(spark), _rules(spark)).select("rule_id", "file_path", "line_number", "severity", "confidence", "engine")


def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and check tables over the documents under their paths."""
    table = rules.from_rows(spark, [*corpus.RULES, {"id": "SECRET-200", "name": "Secret in text", "severity": "high", "tags": ["secret"], "detection": {"patterns": [SECRET]}}])
    found = onepass.scan(_paths(spark, sf_dir), table.filter("enabled"), ("rules", "languages", "iac"))
    return relation.deduplicated(found).select("rule_id", "file_path", "line_number", "severity")


def queries() -> dict[str, Query]:
    over = lambda f: lambda spark, sf_dir: f(_findings(spark, sf_dir))
    on_corpus = lambda f: lambda spark, sf_dir: f(_corpus(spark))
    out: dict[str, Query] = {
        "secret_matches": secret_matches, "secret_entropy": secret_entropy, "file_filter": file_filter, "file_context": file_context, "numbered_snippet": numbered_snippet, "page_checks": page_checks,
        "rule_filter": rule_filter, "rule_stats": lambda spark, d: rules.stats(_rules(spark)), "rules_by_owasp": rules_by_owasp, "rule_file_match": rule_file_match, "rules_anti": rules_anti, "contextual_findings": contextual,
        "framework_gate": framework_gate, "spring_lines": spring_lines, "spring_endpoints": on_corpus(spring.endpoints), "spring_findings": lambda s, d: spring.findings(_corpus(s)).select(*CHECK_COLUMNS),
        "mybatis_statements": lambda s, d: mybatis.statements(_corpus(s)).drop("content"), "mybatis_findings": lambda s, d: mybatis.findings(_corpus(s)).select(*CHECK_COLUMNS), "mybatis_stats": on_corpus(mybatis.statistics),
        "iac_resources": iac_resources, "dedupe_first": dedupe_first, "severity_summary": over(relation.summary), "affected_files": over(relation.affected_files), "top_categories": over(relation.top_categories),
        "conditional_counts": conditional_counts, "exit_code": over(relation.exit_code), "impact_lookup": impact_lookup, "csv_projection": csv_projection, "sarif_rules": sarif_rules, "result_filters": result_filters, "changed_files_semi": changed_files,
        "prioritize": prioritize, "top_n": top_n, "risk_groups": over(priority.risk_groups), "budget_prefix": budget_prefix, "running_cost": running_cost, "cost_estimate": over(priority.cost),
        "containing_method_asof": asof_methods, "call_chains": call_chains, "superclass_chain": superclass_chain, "taint_propagation": taint_propagation, "lattice_join": lattice_join, "many_patterns": many_patterns, "analyzer_function": analyzer_function, "call_reach": call_reach, "call_components": call_components, "taint_sources": taint_sources,
        "methods": on_corpus(callgraph.methods), "calls": lambda s, d: callgraph.calls(_corpus(s), callgraph.methods(_corpus(s))), "taint_findings": lambda s, d: taint.findings(_corpus(s)).select(*CHECK_COLUMNS),
        "usage_stats": usage_stats, "hourly_metrics": hourly_metrics, "enriched_findings": enriched, "full_scan": full_scan, "document_scan": document_scan,
    }
    out |= {f"lang_checks_{x}": partial(_checked, f"language:{x}") for x in LANGUAGES}
    out |= {f"framework_checks_{x}": partial(_checked, f"framework:{x}") for x, (_, table) in FRAMEWORKS.items() if table}
    out |= {f"iac_{x}": partial(_checked, f"iac:{x}") for x in ("terraform", "kubernetes", "dockerfile", "cloudformation")}
    return out | code_queries.queries()


def oracle_sql() -> dict[str, str]:
    f = S.FINDINGS
    out = {
        "secret_matches": SECRET_SQL, "secret_entropy": SECRET_ENTROPY_SQL, "file_filter": FILE_FILTER_SQL, "file_context": FILE_CONTEXT_SQL, "numbered_snippet": SNIPPET_SQL, "page_checks": PAGE_SQL,
        "rule_filter": RULE_FILTER_SQL, "rule_stats": RULE_STATS_SQL, "rules_by_owasp": RULES_BY_OWASP_SQL, "rule_file_match": _rule_sql(), "spring_lines": _spring_sql(), "iac_resources": _resources_sql(),
        "rules_anti": f"WITH r AS ({_rules_sql()}) SELECT rule_id FROM r ANTI JOIN (SELECT rule_id FROM r WHERE list_has_any(tags, ['secret', 'credentials'])) USING (rule_id)", "dedupe_first": DEDUPE_SQL,
        "severity_summary": f"SELECT l.severity, l.severity_rank, count(x.severity) AS n FROM (VALUES ('critical', 5), ('high', 4), ('medium', 3), ('low', 2), ('info', 1)) AS l(severity, severity_rank) LEFT JOIN ({f}) x ON x.severity = l.severity GROUP BY 1, 2",
        "affected_files": f"SELECT DISTINCT file_path FROM ({f})",
        "top_categories": f"SELECT string_split(rule_id, '-')[1] AS category, count(*) AS n FROM ({f}) GROUP BY 1 ORDER BY n DESC, category LIMIT 8",
        "conditional_counts": f"SELECT severity, count(*) AS total, count(*) FILTER (file_path IN ('src/f1.java', 'src/f2.java')) AS matching FROM ({f}) GROUP BY 1",
        "exit_code": f"SELECT CASE max({S.RANK}) WHEN 5 THEN 3 WHEN 4 THEN 2 ELSE CASE WHEN count(*) > 0 THEN 1 ELSE 0 END END AS exit_code FROM ({f})",
        "impact_lookup": IMPACT_SQL, "csv_projection": CSV_SQL, "sarif_rules": SARIF_SQL,
        "result_filters": f"SELECT rule_id, severity, confidence, line_number, match_no, engine_seq FROM ({f}) WHERE {S.RANK} >= 4 AND confidence IN ('high', 'medium') AND cwe = 'CWE-89' AND file_path = 'src/f7.java'",
        "changed_files_semi": f"SELECT file_path, severity, count(*) AS n FROM ({f}) WHERE file_path IN ('src/f3.java', 'src/f4.java') GROUP BY 1, 2",
        "prioritize": f"SELECT severity, owasp, cwe, count(*) AS n, max(priority_score) AS priority_score, max(risk_level) AS risk_level FROM ({PRIORITY_SQL}) GROUP BY 1, 2, 3",
        "top_n": f"SELECT rule_id, priority_score, {', '.join(_TIES)} FROM ({PRIORITY_SQL}) ORDER BY priority_score DESC, {', '.join(_TIES)} LIMIT 25",
        "risk_groups": f"SELECT l.risk_level, count(x.risk_level) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'), ('INFO')) AS l(risk_level) LEFT JOIN ({PRIORITY_SQL}) x ON x.risk_level = l.risk_level GROUP BY 1",
        "budget_prefix": f"SELECT rule_id, priority_score, {', '.join(_TIES)} FROM (SELECT *, sum({priority.unit_cost('full')}) OVER (ORDER BY priority_score DESC, {', '.join(_TIES)} ROWS UNBOUNDED PRECEDING) AS c FROM ({PRIORITY_SQL})) WHERE c <= 2.0 + 1e-9",
        "running_cost": f"SELECT file_path, match_no, engine_seq, rule_ord, round(sum(CAST({priority.unit_cost('full')} AS DOUBLE)) OVER (PARTITION BY file_path ORDER BY priority_score DESC, {', '.join(_TIES[1:])} ROWS UNBOUNDED PRECEDING), 6) AS running_cost FROM ({PRIORITY_SQL})",
        "cost_estimate": f"SELECT count(*) AS n_findings, count(*) * 3500 AS input_tokens, count(*) * 2000 AS output_tokens, round(count(*) * CAST({priority.unit_cost('full')} AS DOUBLE), 6) AS total_cost FROM ({f})",
        "containing_method_asof": ASOF_SQL, "call_chains": CHAINS_SQL, "superclass_chain": SUPERCLASS_SQL, "taint_propagation": TAINT_SQL, "lattice_join": _lattice_sql(), "many_patterns": MANY_SQL, "analyzer_function": ANALYZER_SQL, "call_reach": REACH_SQL, "call_components": COMPONENTS_SQL, "taint_sources": SOURCES_SQL,
        "usage_stats": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1",
        "hourly_metrics": "SELECT date_trunc('hour', ts) AS window_start, event_type AS name, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2",
        "framework_gate": f"""WITH c AS ({corpus.sql()}) SELECT unnest({S.lit(checks.framework_signs_names())}) AS framework, unnest([
          bool_or(lower(name) IN ('manage.py', 'settings.py') OR contains(content, 'from django') OR contains(content, 'import django')), bool_or(contains(content, 'from flask import') OR contains(content, 'Flask(__name__)')),
          bool_or((contains(path, 'package.json') AND (contains(content, '"react"') OR contains(content, '"next"'))) OR (ext IN ('.jsx', '.tsx') AND (contains(content, 'from ''react''') OR contains(content, 'from "react"')))),
          bool_or(ext = '.vue' OR contains(content, '"vue"')), bool_or(name = 'angular.json' OR contains(content, '"@angular/core"')), bool_or(contains(content, '"express"')),
          bool_or(name = 'Gemfile' AND contains(content, 'rails')), bool_or(ext = '.csproj'), bool_or(contains(content, 'github.com/gin-gonic/gin')), bool_or(contains(content, 'laravel/framework')),
          bool_or(ext IN ('.graphql', '.gql')), bool_or(ext = '.proto'), bool_or(name = 'AndroidManifest.xml'), bool_or(name = 'Info.plist' OR contains(path, '.xcodeproj'))]) AS present FROM c""",
    }
    for name, (extensions, table) in LANGUAGES.items():
        out[f"lang_checks_{name}"] = S.check_queries(table, _extensions(extensions)) + (f"\nUNION ALL\n{_php_sql()}" if name == "php" else "")
    for name, table in (("django", DJANGO), ("flask", FLASK), ("react", REACT), ("vue", VUE), ("angular", ANGULAR)):
        out[f"framework_checks_{name}"] = S.check_queries(table, _extensions(FRAMEWORKS[name][0]))
    out["iac_cloudformation"] = S.check_queries(CLOUDFORMATION, "ext IN ('.yaml', '.yml', '.json') AND (contains(content, 'AWSTemplateFormatVersion') OR contains(content, 'Resources:'))")
    out |= {"spring_endpoints": ENDPOINTS_SQL, "mybatis_findings": MAPPER_SQL, "mybatis_stats": "SELECT 1 AS mappers, 5 AS statements, 4 AS interpolated, 80.0::DOUBLE AS percent", "iac_kubernetes": KUBERNETES_SQL, "iac_dockerfile": DOCKERFILE_SQL}
    return out | code_queries.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of rules in documents and the corpus: the first per rule, file and line, most severe first."""
    secret = {"id": "SECRET-200", "name": "Secret in text", "severity": "high", "tags": ["secret"], "detection": {"patterns": [SECRET]}}
    table = rules.from_rows(spark, [*corpus.RULES, secret])
    source = _paths(spark, sf_dir).unionByName(_corpus(spark))
    found = relation.deduplicated(onepass.scan(source, table.filter("enabled"), ("rules",)))
    return relation.ordered(found).select("rule_id", "severity", "file_path", "line_number", "snippet")
