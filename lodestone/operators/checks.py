"""Check tables run over files: one pass, built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import java, matches, nth_line
from lodestone.functions.text import has_any
from lodestone.operators.check_tables import CLOUDFORMATION, DOCKERFILE, FRAMEWORKS, KUBERNETES, LANGUAGES, TERRAFORM, Check
from lodestone.operators.findings import shaped

#: Engines in the order in which a scan runs them.
SEQUENCE = {"framework": 20, "language": 40, "iac": 60}


def _holds(content: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | content.contains(w)
    return out


def _rows(check: Check, ordinal: int) -> list[Column]:
    content, out = F.col("content"), []
    gate = F.lit(True)
    if check.extensions:
        gate = gate & F.col("ext").isin(*check.extensions)
    if check.has:
        gate = gate & _holds(content, check.has)
    if check.hasnt:
        gate = gate & ~_holds(content, check.hasnt)
    if check.path:
        gate = gate & F.lower("path").contains(check.path)

    def row(k: int, n: Column, line: Column, matched: Column, severity: Column | None = None) -> Column:
        text = lambda x: F.lit(x).cast("string")
        return F.struct(
            F.lit(ordinal).alias("rule_ord"), F.lit(k).alias("pattern_idx"), n.cast("int").alias("match_no"), line.cast("int").alias("line_number"), matched.alias("matched"),
            text(check.rule_id).alias("rule_id"), text(check.title).alias("rule_name"), (text(check.severity) if severity is None else severity).alias("severity"),
            text(check.confidence).alias("confidence"), text(check.cwe).alias("cwe"), text(check.owasp).alias("owasp"),
        )

    if check.absent:
        return [F.when(gate, F.array(row(0, F.lit(1), F.lit(1), F.lit(""))))]
    flags = {"ignore_case": "i" in check.flags, "multiline": "m" in check.flags, "dotall": "s" in check.flags}
    reach = max(check.around)
    for k, pattern in enumerate(check.patterns):
        expression = java(pattern, **flags)
        if check.above:
            many = F.when(gate & (F.regexp_count(content, F.lit(expression)) > check.above), F.array(row(k, F.lit(1), F.lit(1), F.lit(""))))
            out.append(many)
            continue
        found = F.when(gate, matches(content, expression, reach))
        before = lambda m: m["before"] if check.around[0] else F.lit("")
        surroundings = lambda m: F.concat(before(m), m["matched"], F.left(m["after"], F.lit(check.around[1])))
        if check.within:
            found = F.filter(found, lambda m: has_any(m["matched"], check.within))
        if check.near:
            near = (lambda m: F.lower(surroundings(m))) if not check.around[0] else surroundings
            found = F.filter(found, lambda m: ~_holds(near(m), check.near))  # noqa: B023
        if check.only:
            found = F.slice(found, 1, check.only)
        severity = (lambda m: F.when(_holds(surroundings(m), check.raised_by), check.raised).otherwise(check.severity)) if check.raised else (lambda m: None)
        out.append(F.transform(found, lambda m, i: row(k, i + 1, m["line"], m["matched"], severity(m))))  # noqa: B023
    return out


def run(files: DataFrame, checks: tuple[Check, ...], engine: str, sequence: int) -> DataFrame:
    """Findings of all checks in files; a file is searched by every check in the one pass that reads it."""
    parts = [F.coalesce(c, F.array()) for i, check in enumerate(checks) for c in _rows(check, i)]
    if not parts:
        return shaped(files.limit(0).select(F.col("path").alias("file_path")))
    found = files.select("path", "content", F.explode(F.concat(*parts)).alias("m")).select(F.col("path").alias("file_path"), "content", "m.*")
    snippet = F.left(F.trim(F.coalesce(nth_line(F.col("content"), F.col("line_number")), F.lit(""))), F.lit(200))
    return shaped(found, engine=engine, engine_seq=sequence, snippet=snippet, matched_pattern=F.left("matched", F.lit(100)))


def language_checks(files: DataFrame, language: str) -> DataFrame:
    """The checks of one language over its files."""
    extensions, checks = LANGUAGES[language]
    found = run(files.filter(F.col("ext").isin(*extensions)), checks, f"language:{language}", SEQUENCE["language"] + list(LANGUAGES).index(language))
    return found.unionByName(php_variables(files)) if language == "php" else found


def php_variables(files: DataFrame) -> DataFrame:
    """Commands run on a variable that the same file fills from a request: a semi-join within each file."""
    content = F.col("content")
    use = java(r"(?:exec|shell_exec|system|passthru|popen)\s*\(\s*\$(\w+)\s*\)")
    tainted = F.regexp_extract_all(content, F.lit(java(r"\$(\w+)\s*=\s*\$_(?:GET|POST|REQUEST|COOKIE|SERVER)")), F.lit(1))
    rows = files.filter(F.col("ext").isin(*LANGUAGES["php"][0])).select("path", "content", tainted.alias("tainted"), F.posexplode(matches(content, use)).alias("i", "m"))
    hit = rows.filter(F.array_contains("tainted", F.regexp_extract("m.matched", use, 1)))
    return shaped(
        hit.select(F.col("path").alias("file_path"), F.col("m.line").alias("line_number"), (F.col("i") + 1).alias("match_no"), F.trim(nth_line(content, F.col("m.line"))).alias("snippet"), F.col("m.matched").alias("matched_pattern")),
        engine="language:php", engine_seq=SEQUENCE["language"] + list(LANGUAGES).index("php"), rule_ord=1, pattern_idx=2, rule_id="PHP-CMDI-001", rule_name="Command Injection", severity="critical", confidence="high", cwe="CWE-78", owasp="A03",
    )


# What shows that a project uses a framework: file names, path ends, and texts in files of a kind.
def framework_signs() -> dict[str, Column]:
    name, path, ext, content = F.lower("name"), F.col("path"), F.col("ext"), F.col("content")
    has = content.contains
    return {
        "django": name.isin("manage.py", "settings.py") | has("from django") | has("import django"),
        "flask": has("from flask import") | has("Flask(__name__)"),
        "react": (path.contains("package.json") & (has('"react"') | has('"next"'))) | (ext.isin(".jsx", ".tsx") & (has("from 'react'") | has('from "react"'))),
        "vue": (ext == ".vue") | has('"vue"'),
        "angular": (F.col("name") == "angular.json") | has('"@angular/core"'),
        "express": has('"express"'),
        "rails": (F.col("name") == "Gemfile") & (has("'rails'") | has('"rails"')),
        "aspnet": ext == ".csproj",
        "gin": has("github.com/gin-gonic/gin"),
        "laravel": has("laravel/framework"),
        "graphql": ext.isin(".graphql", ".gql"),
        "grpc": ext == ".proto",
        "android": F.col("name") == "AndroidManifest.xml",
        "ios": (F.col("name") == "Info.plist") | path.contains(".xcodeproj"),
    }


def framework_signs_names() -> tuple[str, ...]:
    return tuple(FRAMEWORKS)


def frameworks(files: DataFrame) -> DataFrame:
    """(framework, present) of every framework: one aggregate over the files."""
    signs = framework_signs()
    one = files.agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(k) for k, c in signs.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("framework"), F.col(k).alias("present")) for k in signs])).alias("x")).select("x.*")


def framework_checks(files: DataFrame, framework: str, gated: bool = True) -> DataFrame:
    """A framework's checks; gated: only if the files use it (a one-row gate that joins them)."""
    extensions, checks = FRAMEWORKS[framework]
    found = run(files.filter(F.col("ext").isin(*extensions)), checks, f"framework:{framework}", SEQUENCE["framework"] + list(FRAMEWORKS).index(framework))
    if not gated:
        return found
    gate = files.agg(F.coalesce(F.bool_or(framework_signs()[framework]), F.lit(False)).alias("present")).filter("present").select(F.lit(1).alias("one"))
    return found.withColumn("one", F.lit(1)).join(F.broadcast(gate), "one", "left_semi").drop("one")  # one row at most


def iac_checks(files: DataFrame, kind: str) -> DataFrame:
    """Checks of infrastructure files: terraform, kubernetes, dockerfile or cloudformation."""
    name, ext, has = F.lower("name"), F.col("ext"), F.col("content").contains
    gates = {
        "terraform": (ext.isin(".tf", ".tfvars"), TERRAFORM),
        "kubernetes": (ext.isin(".yaml", ".yml") & has("apiVersion:") & has("kind:"), KUBERNETES),
        "dockerfile": ((name == "dockerfile") | name.startswith("dockerfile."), DOCKERFILE),
        "cloudformation": (ext.isin(".yaml", ".yml", ".json") & (has("AWSTemplateFormatVersion") | has("Resources:")), CLOUDFORMATION),
    }
    gate, checks = gates[kind]
    found = run(files.filter(gate & (F.col("content") != "")), checks, f"iac:{kind}", SEQUENCE["iac"] + list(gates).index(kind))
    width = 80 if kind == "terraform" else 60
    return found.withColumn("snippet", F.coalesce(F.left("matched_pattern", F.lit(width)), F.lit("")))


def iac_resources(files: DataFrame, kind: str) -> DataFrame:
    """(resource_type, name, file_path, line_number, provider) of declared resources."""
    content = F.col("content")
    shapes = {
        "terraform": (F.col("ext").isin(".tf", ".tfvars"), r'resource\s*"([^"]+)"\s*"([^"]+)"', 1, 2),
        "dockerfile": (F.lower("name").startswith("dockerfile"), r"FROM\s+(\S+)()", 2, 1),
        "cloudformation": (F.col("ext").isin(".yaml", ".yml", ".json"), r"""(\w+):\s*\n\s*Type:\s*["\']?(AWS::[^\s"\']+)""", 2, 1),
        "kubernetes": (F.col("ext").isin(".yaml", ".yml") & content.contains("apiVersion:") & content.contains("kind:"), r"(?m)^kind:\s*(\S+)[\s\S]*?^\s+name:\s*(\S+)", 1, 2),
    }
    gate, pattern, type_at, name_at = shapes[kind]
    expression = java(pattern)
    rows = files.filter(gate).select("path", F.explode(matches(content, expression)).alias("m"))
    part = lambda k: F.regexp_extract("m.matched", expression, k)
    kind_of = part(type_at) if kind != "dockerfile" else F.lit("base_image")
    provider = {
        "terraform": F.when(kind_of.startswith("aws_"), "aws").when(kind_of.rlike("^(?:google|gcp)_"), "gcp").when(kind_of.startswith("azurerm_"), "azure").otherwise("unknown"),
        "dockerfile": F.lit("docker"), "cloudformation": F.lit("aws"), "kubernetes": F.lit("kubernetes"),
    }[kind]
    line = F.lit(1) if kind == "kubernetes" else F.col("m.line")
    return rows.select(kind_of.alias("resource_type"), part(name_at).alias("name"), F.col("path").alias("file_path"), line.alias("line_number"), provider.alias("provider"))
