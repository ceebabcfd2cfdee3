"""Spring applications: endpoints, security configuration, repositories, settings, and what they say together.

Lines are judged inside their file: what is carried forward or looked at
around a line are slices of the file's array of lines, so nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import java
from lodestone.operators.findings import shaped, union_all

# Annotations and patterns.
CONTROLLER = r"@(Controller|RestController)"
SECURED = r"@(PreAuthorize|Secured|RolesAllowed)"
VALIDATED = r"@(Valid|Validated)"
CLASS = java(r"(?:public\s+)?class\s+(\w+)")
CLASS_MAPPING = java(r"@RequestMapping\s*\(\s*[\"\']([^\"\']+)[\"\']")
MAPPING = java(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\([^)]*\))?")
PATH = java(r"@\w+Mapping\s*\(\s*(?:value\s*=\s*)?[\"\']([^\"\']*)[\"\']")
METHOD = java(r"public\s+\w+\s+(\w+)\s*\(([^)]*)\)")
CSRF_OFF = (r"csrf\s*\(\s*\)\s*\.\s*disable\s*\(", r"csrf\s*\(.*AbstractHttpConfigurer::disable", r"\.csrf\(\)\s*\.disable\(\)")
CORS_ALL = (r"allowedOrigins\s*\(\s*[\"\']?\*[\"\']?\s*\)", r"allowedOriginPatterns\s*\(\s*[\"\']?\*[\"\']?\s*\)")
PERMIT_ALL = (r"anyRequest\s*\(\s*\)\s*\.\s*permitAll",)
NO_FIXATION = (r"sessionFixation\s*\(\s*\)\s*\.\s*none\s*\(",)
JPA = (r"@Query\s*\([^)]*[\"\'].*\+\s*", r"@Query\s*\([^)]*\$\{", r"createNativeQuery\s*\([^)]*\+", r"createQuery\s*\([^)]*\+")
ACTUATOR = (r"management\.endpoints\.web\.exposure\.include\s*=\s*\*", r"management\.security\.enabled\s*=\s*false", r"exposure:\s*\n\s*include:\s*\*")
DEBUG = (r"(?i)debug\s*[=:]\s*true",)
HTTP_ONLY_OFF = (r"(?i)http-only\s*[=:]\s*false",)


def _any(line: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | line.rlike(java(p))
    return out


def _around(first: Column, last: Column) -> Column:
    """The lines of the current row's file from first to last, from 1."""
    a = F.greatest(first, F.lit(1))
    return F.array_join(F.slice("lines", a, F.greatest(last - a + 1, F.lit(0))), "\n")


def endpoints(files: DataFrame) -> DataFrame:
    """(path, line_number, class_name, method_name, http_method, url, params, has_authentication, has_validation, snippet)."""
    java_files = files.filter((F.col("ext") == ".java") & F.col("content").rlike(CONTROLLER))
    rows = java_files.select("path", F.split("content", "\n", -1).alias("lines"))
    # a file's classes, each with the last class mapping up to it
    heads = F.filter(F.transform("lines", lambda line, i: F.when(line.rlike(CLASS), i + 1)), lambda x: x.isNotNull())
    rows = rows.withColumn("heads", heads)
    named = F.transform(
        "heads",
        lambda i: F.struct(
            i.alias("number"),
            F.regexp_extract(F.element_at("lines", i), CLASS, 1).alias("name"),
            F.when(i > 1, F.regexp_extract(_around(i - 4, i), CLASS_MAPPING, 1)).otherwise("").alias("mapping"),
        ),
    )
    rows = rows.withColumn("classes", named)

    def of_line(line: Column, number: Column) -> Column:
        ahead = _around(number, number + 10)
        before = F.filter("classes", lambda c: c["number"] <= number)
        mapped = F.filter(before, lambda c: c["mapping"] != "")
        verb = F.upper(F.regexp_extract(line, MAPPING, 1))
        hit = F.struct(
            number.cast("int").alias("line_number"),
            F.try_element_at(before, F.lit(-1))["name"].alias("class_name"),
            F.regexp_extract(ahead, METHOD, 1).alias("method_name"),
            F.when(verb == "REQUEST", "GET").otherwise(verb).alias("http_method"),
            F.concat(F.coalesce(F.try_element_at(mapped, F.lit(-1))["mapping"], F.lit("")), F.regexp_extract(line, PATH, 1)).alias("url"),
            F.regexp_extract(ahead, METHOD, 2).alias("params"),
            _around(number - 2, number + 1).rlike(SECURED).alias("has_authentication"),
            ahead.rlike(VALIDATED).alias("has_validation"),
            F.trim(line).alias("snippet"),
        )
        return F.when(line.rlike(MAPPING), F.when((F.size(before) > 0) & ahead.rlike(METHOD), hit))

    found = F.filter(F.transform("lines", lambda line, i: of_line(line, i + 1)), lambda x: x.isNotNull())
    return rows.select("path", F.explode(found).alias("h")).select("path", "h.*")


def security_configs(files: DataFrame) -> DataFrame:
    """(path, csrf_enabled, cors_allow_all) of each security configuration."""
    content = F.col("content")
    rows = files.filter((F.col("ext") == ".java") & (content.contains("SecurityFilterChain") | content.contains("WebSecurityConfigurerAdapter")))
    lines = F.split(content, "\n", -1)
    return rows.select("path", (~F.exists(lines, lambda x: _any(x, CSRF_OFF))).alias("csrf_enabled"), F.exists(lines, lambda x: _any(x, CORS_ALL)).alias("cors_allow_all"))


#: Rule id, title, severity, confidence, CWE, OWASP and tags beside "spring".
RULES = (
    ("SPRING-VALID-001", "Missing Input Validation", "medium", "high", "CWE-20", "A03", ("validation", "input")),
    ("SPRING-SEC-001", "CSRF Protection Disabled", "high", "high", "CWE-352", "A01", ("csrf", "security-config")),
    ("SPRING-SEC-002", "Insecure CORS Configuration", "medium", "high", "CWE-942", "A01", ("cors", "security-config")),
    ("SPRING-SEC-003", "Permissive Security Configuration", "critical", "high", "CWE-862", "A01", ("authentication", "security-config")),
    ("SPRING-SEC-004", "Session Fixation Protection Disabled", "medium", "high", "CWE-384", "A07", ("session", "security-config")),
    ("SPRING-JPA-001", "SQL Injection in JPA Query", "critical", "high", "CWE-89", "A03", ("jpa", "sql-injection")),
    ("SPRING-JPA-002", "SQL Injection in Native Query", "critical", "high", "CWE-89", "A03", ("jpa", "sql-injection", "native-query")),
    ("SPRING-INPUT-001", "Missing Request Body Validation", "low", "medium", "CWE-20", "A03", ("validation", "input")),
    ("SPRING-CFG-001", "Actuator Endpoints Exposed", "high", "high", "CWE-200", "A01", ("actuator", "config")),
    ("SPRING-CFG-002", "Debug Mode Enabled", "medium", "medium", "CWE-489", "A05", ("debug", "config")),
    ("SPRING-CFG-003", "Insecure Session Cookie", "medium", "high", "CWE-614", "A07", ("session", "cookie", "config")),
    ("SPRING-XFILE-001", "Unprotected State-Changing Endpoint", "high", "medium", "CWE-352", "A01", ("csrf", "endpoint-security")),
)
_ORDER = {r[0]: k for k, r in enumerate(RULES)}


def _graded(found: DataFrame) -> DataFrame:
    """Findings of (path, line_number, snippet, rule_id)."""
    value = lambda k: F.element_at(F.create_map(*[F.lit(x) for r in RULES for x in (r[0], r[k])]), F.col("rule_id"))
    tags = F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(r[0]), F.array(*map(F.lit, ("spring", *r[6]))))]), F.col("rule_id"))
    idx = F.element_at(F.create_map(*[F.lit(x) for pair in _ORDER.items() for x in pair]), F.col("rule_id"))
    rows = found.withColumn("file_path", F.col("path"))
    return shaped(rows, engine="spring", engine_seq=11, rule_ord=idx, pattern_idx=idx, match_no=F.col("line_number"), rule_name=value(1), severity=value(2), confidence=value(3), cwe=value(4), owasp=value(5), tags=tags)


def _line_findings(files: DataFrame) -> DataFrame:
    """(path, line_number, snippet, rule_id) of the rules that judge a line with those around it, in one pass over each file's lines."""
    content = F.col("content")
    is_java, has = F.col("ext") == ".java", lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: content.contains(w))
    rows = files.select(
        "path",
        F.split("content", "\n", -1).alias("lines"),
        (is_java & has("SecurityFilterChain", "WebSecurityConfigurerAdapter")).alias("config"),
        (is_java & has("@Repository", "JpaRepository", "CrudRepository")).alias("repository"),
        (is_java & content.rlike(CONTROLLER)).alias("controller"),
        F.col("ext").isin(".yml", ".yaml", ".properties").alias("settings"),
    ).filter("config OR repository OR controller OR settings")

    def of_line(line: Column, number: Column) -> Column:
        # a query's text goes on to the first line with a closing parenthesis
        after = F.slice("lines", number, F.size("lines"))
        ends = F.array_position(F.transform(after, lambda x: x.contains(")")), True)
        query = F.array_join(F.slice(after, F.lit(1), F.when(ends > 0, ends).otherwise(F.size(after)).cast("int")), " ")
        native = query.contains("nativeQuery") & F.lower(query).contains("true") & (query.contains("${") | query.contains("+"))
        previous = F.element_at("lines", F.greatest(number - 1, F.lit(1)))
        unvalidated = line.contains("@RequestBody") & ~line.contains("@Valid") & (number > 1) & ~previous.contains("@Valid") & ~_around(number - 4, number + 3).contains("@Valid")
        at_query = F.col("repository") & line.contains("@Query")
        hits = {
            "SPRING-SEC-001": F.col("config") & _any(line, CSRF_OFF),
            "SPRING-SEC-002": F.col("config") & _any(line, CORS_ALL),
            "SPRING-SEC-003": F.col("config") & _any(line, PERMIT_ALL),
            "SPRING-SEC-004": F.col("config") & _any(line, NO_FIXATION),
            "SPRING-JPA-001": F.when(at_query, _any(query, JPA)),
            "SPRING-JPA-002": F.when(at_query, native),
            "SPRING-INPUT-001": F.col("controller") & unvalidated,
            "SPRING-CFG-001": F.col("settings") & _any(line, ACTUATOR),
            "SPRING-CFG-002": F.col("settings") & _any(line, DEBUG),
            "SPRING-CFG-003": F.col("settings") & _any(line, HTTP_ONLY_OFF),
        }
        found = [F.when(hit, F.struct(number.cast("int").alias("line_number"), F.trim(line).alias("snippet"), F.lit(rule).alias("rule_id"))) for rule, hit in hits.items()]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    found = F.flatten(F.transform("lines", lambda line, i: of_line(line, i + 1)))
    return rows.select("path", F.explode(found).alias("h")).select("path", "h.*")


def findings(files: DataFrame) -> DataFrame:
    """All SPRING rules over the files of an application."""
    ends_at = endpoints(files)
    without = ends_at.filter(F.col("http_method").isin("POST", "PUT") & ~F.col("has_validation") & F.col("params").contains("@RequestBody"))
    invalid = without.select("path", "line_number", "snippet", F.lit("SPRING-VALID-001").alias("rule_id"))
    return _graded(union_all(invalid, _line_findings(files), unprotected(files)))


#: Parts of file names and whole names that make a project one of Spring's, else words in its first files.
PROJECT_PARTS = ("Controller", "Config", "Repository", "Service")
PROJECT_NAMES = ("application.yml", "application.yaml", "application.properties")
PROJECT_WORDS = ("@Controller", "@RestController", "@SpringBootApplication", "@Service")
PROBED_FILES = 10


def is_project(files: DataFrame) -> DataFrame:
    """One row, ``spring``: whether the files look like a Spring project, by any file's name or what the first ten of its kinds (by path) hold."""
    some = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))
    kinds = files.filter(F.col("ext").isin(".java", ".yml", ".yaml", ".properties"))
    by_name = kinds.agg(F.bool_or(some(F.col("name"), PROJECT_PARTS) | F.col("name").isin(*PROJECT_NAMES)).alias("x"))
    probed = kinds.orderBy("path").limit(PROBED_FILES).agg(F.bool_or(some(F.col("content"), PROJECT_WORDS)).alias("x"))
    return by_name.unionByName(probed).agg(F.coalesce(F.bool_or("x"), F.lit(False)).alias("spring"))


def project_findings(files: DataFrame) -> DataFrame:
    """The SPRING findings of files that look like a Spring project, of others none."""
    gate = is_project(files).filter("spring").select(F.lit(1).alias("one"))
    found = findings(files)
    return found.withColumn("one", F.lit(1)).join(F.broadcast(gate), "one", "left_semi").select(*found.columns)  # one row at most


def unprotected(files: DataFrame) -> DataFrame:
    """(path, line_number, snippet, rule_id) of state-changing endpoints without authentication, if any configuration turns CSRF protection off."""
    gate = security_configs(files).agg(F.coalesce(F.bool_or(~F.col("csrf_enabled")), F.lit(False)).alias("off")).filter("off").select(F.lit(1).alias("one"))
    rows = endpoints(files).filter(F.col("http_method").isin("POST", "PUT", "DELETE", "PATCH") & ~F.col("has_authentication")).withColumn("one", F.lit(1))
    rows = rows.join(F.broadcast(gate), "one", "left_semi")  # one row at most
    snippet = F.concat(F.lit("@"), F.initcap(F.lower("http_method")), F.lit("Mapping"))
    return rows.select("path", "line_number", snippet.alias("snippet"), F.lit("SPRING-XFILE-001").alias("rule_id"))
