"""Mapper files: statements, interpolated parameters, and what is wrong with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import java
from lodestone.operators.findings import shaped, union_all

# Texts of mapper files, parameter names, and patterns.
INDICATORS = ("<!DOCTYPE mapper", "mybatis.org/dtd/mybatis", "<mapper namespace=", "<select id=", "<insert id=", "<update id=", "<delete id=")
DANGEROUS = (
    "orderby", "order", "sortby", "sort", "column", "field", "table", "tablename", "columns", "fields", "limit", "offset", "groupby", "group", "having",
    "where", "condition", "name", "search", "query", "keyword", "filter", "id", "ids", "value", "values", "param", "input",
)
SAFE = ("item", "index", "collection", "separator", "open", "close", "_parameter", "_databaseid")
OPEN = java(r"<(select|insert|update|delete)\s+id\s*=\s*[\"\']([^\"\']+)[\"\']([^>]*)>", ignore_case=True)
PARAMETER = r"\$\{([^}]+)\}"
IF = java(r"<if\s+test=[\"\'][^\"\']+[\"\']>\s*[^<]*\$\{([^}]+)\}", ignore_case=True)
FOREACH = java(r"<foreach[^>]*>\s*[^<]*\$\{([^}]+)\}", ignore_case=True)
LIKE = java(r"like\s+['\"]?%?\s*\$\{([^}]+)\}\s*%?['\"]?", ignore_case=True)


def is_mapper() -> Column:
    out = F.lit(False)
    for text in INDICATORS:
        out = out | F.col("content").contains(text)
    return (F.col("ext") == ".xml") & out


_STATE = "struct<open:struct<id:string,kind:string,line:int,sql:array<string>>,done:array<struct<id:string,kind:string,line:int,sql:array<string>>>>"


def statements(files: DataFrame) -> DataFrame:
    """(path, statement_id, statement_type, line_number, sql, params, namespace) of every mapper statement.

    One fold over the lines of a file carries the open statement forward; it
    ends at its own closing tag, at the next opening tag or at the file's end.
    """
    lines = F.split("content", "\n", -1)
    some = lambda x: F.when(F.trim(x) != "", F.array(x)).otherwise(F.array().cast("array<string>"))

    def follow(state: Column, item: Column) -> Column:
        line, number = item["line"], item["number"]
        current, done = state["open"], state["done"]
        tag = F.regexp_extract(line, OPEN, 0)
        rest = F.substr(line, F.call_function("instr", line, tag) + F.length(tag))
        opened = F.struct(
            F.regexp_extract(line, OPEN, 2).alias("id"), F.lower(F.regexp_extract(line, OPEN, 1)).alias("kind"), number.alias("line"),
            F.when(F.trim(rest).startswith("</"), F.array().cast("array<string>")).otherwise(some(rest)).alias("sql"),
        )
        close = F.concat(F.lit("</"), current["kind"], F.lit(">"))
        at = F.call_function("instr", F.lower(line), close)
        before = F.when(at > 1, F.substr(line, F.lit(1), at - 1)).otherwise(F.lit(""))
        finished = lambda tail: F.concat(done, F.array(F.struct(current["id"].alias("id"), current["kind"].alias("kind"), current["line"].alias("line"), F.concat(current["sql"], tail).alias("sql"))))
        none = F.array().cast("array<string>")
        return (
            F.when(line.rlike(OPEN), F.struct(opened.alias("open"), F.when(current.isNotNull(), finished(none)).otherwise(done).alias("done")))
            .when(current.isNull(), state)
            .when(at > 0, F.struct(F.lit(None).cast("struct<id:string,kind:string,line:int,sql:array<string>>").alias("open"), finished(some(before)).alias("done")))
            .otherwise(F.struct(F.struct(current["id"].alias("id"), current["kind"].alias("kind"), current["line"].alias("line"), F.concat(current["sql"], F.array(line)).alias("sql")).alias("open"), done.alias("done")))
            .cast(_STATE)
        )

    numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), (i + 1).alias("number")))
    start = F.struct(F.lit(None).cast("struct<id:string,kind:string,line:int,sql:array<string>>").alias("open"), F.array().cast("array<struct<id:string,kind:string,line:int,sql:array<string>>>").alias("done")).cast(_STATE)
    found = F.aggregate(numbered, start, follow, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    namespace = F.regexp_extract("content", r"<mapper\s+namespace\s*=\s*[\"\']([^\"\']+)[\"\']", 1)
    rows = files.filter(is_mapper()).select("path", "content", F.when(namespace != "", namespace).otherwise("unknown").alias("namespace"), F.posexplode(found).alias("statement_no", "s"))
    sql = F.array_join("s.sql", "\n")
    return rows.select("path", "content", "namespace", "statement_no", F.col("s.id").alias("statement_id"), F.col("s.kind").alias("statement_type"), F.col("s.line").alias("line_number"), sql.alias("sql"), listed(F.regexp_extract_all(sql, F.lit(PARAMETER), F.lit(1))).alias("params"))


def listed(found: Column) -> Column:
    """Parameters in order; one is left out when its own base name is already listed."""
    return F.aggregate(found, F.array().cast("array<string>"), lambda a, p: F.when((base(p) != "") & ~F.array_contains(a, base(p)), F.concat(a, F.array(p))).otherwise(a))


def base(param: Column) -> Column:
    return F.trim(F.element_at(F.split(param, r"\."), 1))


def _context(param: Column) -> Column:
    """The first of a statement's lines, up to 21 from its own, with the parameter; else its own line."""
    lines = F.split("content", "\n", -1)
    near = F.filter(F.slice(lines, F.col("line_number"), F.lit(21)), lambda x: F.lower(x).contains(F.lower(F.concat(F.lit("${"), param))))
    return F.trim(F.coalesce(F.try_element_at(near, F.lit(1)), F.try_element_at(lines, F.col("line_number"))))


def findings(files: DataFrame) -> DataFrame:
    """MYBATIS-001 to 004."""
    rows = statements(files).withColumn("file_path", F.col("path"))
    lower, p = F.lower("sql"), F.col("p")
    after = lambda words: lower.contains(words) & F.substr(lower, F.call_function("instr", lower, F.lit(words))).contains(F.lower(p))
    quoted = F.concat(F.lit(r"\Q${"), p, F.lit(r"}\E"))
    beside = lambda word: F.call_function("regexp_like", lower, F.concat(F.lit(word + r"\s+"), quoted))
    context = after("order by") | after("group by") | beside("from") | beside("join") | beside("into")
    name = F.lower(base(p))
    dangerous = F.lit(False)
    for d in DANGEROUS:
        dangerous = dangerous | name.contains(d)
    one = rows.select("*", F.posexplode("params").alias("k", "p")).filter(~name.isin(*SAFE))
    plain = shaped(
        one.withColumn("snippet", _context(p)), rule_id="MYBATIS-001", rule_name="SQL Injection via MyBatis Interpolation", severity=F.when(context, "critical").otherwise("high"),
        confidence=F.when(context | dangerous, "high").otherwise("medium"), pattern_idx=0, **_common("interpolation"),
    )

    def dynamic(rule: str, title: str, tag: str, found: Column, safe: tuple[str, ...], severity: str, confidence: str, idx: int) -> DataFrame:
        each = rows.select("*", F.posexplode(found).alias("k", "p")).filter(~F.lower(base(p)).isin(*safe) if safe else F.lit(True))
        return shaped(each.withColumn("snippet", _context(p)), rule_id=rule, rule_name=title, severity=severity, confidence=confidence, pattern_idx=idx, **_common(tag))

    sql = F.col("sql")
    return union_all(
        plain,
        dynamic("MYBATIS-002", "Dynamic SQL with Interpolation", "dynamic-sql", F.regexp_extract_all(sql, F.lit(IF), F.lit(1)), SAFE, "high", "medium", 1),
        dynamic("MYBATIS-003", "Foreach with Interpolation", "foreach", F.regexp_extract_all(sql, F.lit(FOREACH), F.lit(1)), SAFE[:3], "high", "medium", 2),
        dynamic("MYBATIS-004", "LIKE Clause with Interpolation", "like", F.slice(F.regexp_extract_all(sql, F.lit(LIKE), F.lit(1)), 1, 1), (), "critical", "high", 3),
    )


def _common(tag: str) -> dict:
    return {"engine": "mybatis", "engine_seq": 12, "rule_ord": F.col("statement_no"), "match_no": F.col("k"), "cwe": "CWE-89", "owasp": "A03", "tags": F.array(F.lit("mybatis"), F.lit("sql-injection"), F.lit(tag))}


def statistics(files: DataFrame) -> DataFrame:
    """One row: mappers, statements, those with interpolation, and their share in percent."""
    rows = statements(files)
    interpolated = F.count_if(F.size("params") > 0)
    share = F.when(F.count(F.lit(1)) > 0, F.round(100.0 * interpolated / F.count(F.lit(1)), 2)).otherwise(0.0)
    return rows.agg(F.countDistinct("path").alias("mappers"), F.count(F.lit(1)).alias("statements"), interpolated.alias("interpolated"), share.alias("percent"))
