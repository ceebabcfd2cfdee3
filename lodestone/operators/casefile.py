"""What a reader of a finding wants to see of its file and of the call graph around it.

A finding joins its file's lines once; all that is taken from them are
slices and filters of that array, and only these go on.  Callers and callees
are joined by the method that contains the finding, five of each at most, as
the feature is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.regex import java
from lodestone.functions.text import fingerprint, numbered_snippet, suffix
from lodestone.operators.callgraph import containing

# Headers, mappings, and what is looked for beside findings of a kind.
CLASS = "^" + java(r"(public\s+|private\s+|protected\s+)?(abstract\s+)?(class|interface|enum)\s+\w+")
METHOD = "^" + java(r"(public|private|protected)?\s*(static)?\s*[\w<>\[\],\s]+\s+(\w+)\s*\([^)]*\)")
MAPPINGS = {"@GetMapping": "GET endpoint", "@PostMapping": "POST endpoint", "@PutMapping": "PUT endpoint", "@DeleteMapping": "DELETE endpoint"}
SQL_CODE = ("executeQuery", "executeUpdate", "createQuery", "prepareStatement")
FILE_CODE = ("new File", "Files.", "FileInputStream", "FileOutputStream")
#: Lines around a finding, lines that hold imports, and the most callers, callees and related pieces.
AROUND, IMPORT_LINES, MOST_CALLS, MOST_RELATED = 15, 100, 5, 3


def _line(i: Column) -> Column:
    return F.element_at("lines", i)


def _joined(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("lines", first, F.greatest(last - first + 1, F.lit(0))), "\n")


def _last_before(hit) -> Column:
    """The last line up to the finding's that is a hit; null without one."""
    upto = F.least(F.col("line_number"), F.size("lines"))
    numbers = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    return F.try_element_at(F.filter(numbers, lambda i: hit(F.trim(_line(i)))), F.lit(-1))


def imports() -> Column:
    """The import lines of a file's first lines; a Java package comes first."""
    head = F.transform(F.slice("lines", 1, IMPORT_LINES), lambda x: F.trim(x))
    ext = suffix(F.col("file_path"))
    starts = lambda *words: lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: x.startswith(w))
    of_java = F.concat(F.reverse(F.filter(head, starts("package "))), F.filter(head, starts("import ")))
    script = F.filter(head, lambda x: x.startswith("import ") | x.contains("require("))
    none = F.array().cast("array<string>")
    return F.when(ext == ".java", of_java).when(ext == ".py", F.filter(head, starts("import ", "from "))).when(ext.isin(".js", ".ts", ".jsx", ".tsx"), script).otherwise(none)


def class_context() -> Column:
    """The header of the class that begins last before the finding, up to its opening brace."""
    at = _last_before(lambda x: x.rlike(CLASS) | x.startswith("class "))
    after = F.slice("lines", at + 1, F.size("lines"))
    brace = F.array_position(F.transform(after, lambda x: x.contains("{")), True)
    last = F.when(_line(at).contains("{"), at).when(brace > 0, at + brace.cast("int")).otherwise(F.size("lines"))
    return F.when(at.isNotNull() & F.trim(_line(at)).rlike(CLASS), _joined(at, last)).when(at.isNotNull(), F.trim(_line(at)))


def method_context() -> Column:
    """The header of the method that begins last before the finding, with the five lines above it."""
    at = _last_before(lambda x: x.rlike(METHOD) | x.startswith("def ") | x.startswith("async def "))
    above = F.when(F.trim(_line(at)).rlike(METHOD), F.lit(5)).otherwise(F.lit(3))
    return F.when(at.isNotNull(), _joined(F.greatest(at - above, F.lit(1)), at))


def annotations() -> Column:
    """Names and lines of the annotations in the ten lines up to the finding."""
    first = F.greatest(F.col("line_number") - 9, F.lit(1))
    near = F.transform(F.slice("lines", first, F.greatest(F.col("line_number") - first + 1, F.lit(0))), lambda x: F.trim(x))
    name = lambda x: F.regexp_extract(x, java(r"^@(\w+)"), 1)
    both = F.transform(F.filter(near, lambda x: x.startswith("@")), lambda x: F.when(name(x) != "", F.array(name(x), x)).otherwise(F.array(x)))
    return F.flatten(both)


def framework_context() -> Column:
    """What the file's words say of its part in an application; null if nothing."""
    has = lambda *words: F.exists(F.array(*map(F.lit, words)), lambda w: F.col("content").contains(w))
    first = F.greatest(F.col("line_number") - 4, F.lit(1))
    near = F.slice("lines", first, F.greatest(F.col("line_number") + 2 - first + 1, F.lit(0)))
    verb = lambda x: F.coalesce(*[F.when(x.contains(k), v) for k, v in MAPPINGS.items()])
    verbs = F.filter(F.transform(near, verb), lambda x: x.isNotNull())
    controller = has("@RestController", "@Controller")
    none = F.array().cast("array<string>")
    said = F.concat(
        F.when(controller, F.concat(F.array(F.lit("Spring MVC Controller")), verbs)).otherwise(none),
        F.when(has("@Service"), F.array(F.lit("Spring Service"))).otherwise(none),
        F.when(has("@Repository"), F.array(F.lit("Spring Repository/DAO"))).otherwise(none),
        F.when(F.lower("content").contains("mybatis") | has("#{", "${"), F.array(F.lit("MyBatis Mapper"))).otherwise(none),
        F.when(has("SecurityFilterChain", "@PreAuthorize"), F.array(F.lit("Spring Security"))).otherwise(none),
    )
    return F.nullif(F.array_join(said, ", "), F.lit(""))


def related() -> Column:
    """Up to three pieces of the file with code of the finding's kind, by the order of what is looked for and then of lines."""
    rule, title = F.lower("rule_id"), F.lower(F.coalesce("rule_name", F.lit("")))
    none = F.array().cast("array<string>")
    wanted = F.concat(
        F.when(rule.contains("sql") | title.contains("injection"), F.array(*map(F.lit, SQL_CODE))).otherwise(none),
        F.when(rule.contains("path") | title.contains("file"), F.array(*map(F.lit, FILE_CODE))).otherwise(none),
    )
    numbers = F.when(F.size("lines") > 0, F.sequence(F.lit(1), F.size("lines"))).otherwise(F.array().cast("array<int>"))

    def of(word: Column) -> Column:
        at = F.slice(F.filter(numbers, lambda i: _line(i).contains(word) & (i != F.col("line_number"))), 1, MOST_RELATED)
        return F.transform(at, lambda i: F.struct(i.alias("line"), _joined(F.greatest(i - 1, F.lit(1)), i + 3).alias("snippet"), F.concat(F.lit("Related: contains '"), word, F.lit("'")).alias("reason")))

    return F.slice(F.flatten(F.transform(wanted, of)), 1, MOST_RELATED)


def contexts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings with key, code, imports, class_context, method_context, annotations, framework_context and related; empty without the file."""
    source = files.select(F.col("path").alias("file_path"), "content", F.split("content", "\n", -1).alias("lines"))
    rows = findings.join(source, "file_path", "left").withColumns({"content": F.coalesce("content", F.lit("")), "lines": F.coalesce("lines", F.array().cast("array<string>"))})
    code = F.when(F.size("lines") > 0, numbered_snippet(F.col("content"), F.least(F.col("line_number"), F.size("lines")), AROUND)).otherwise("")
    made = {
        "key": fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_number")),
        "code": code,
        "imports": imports(),
        "class_context": class_context(),
        "method_context": method_context(),
        "annotations": annotations(),
        "framework_context": framework_context(),
        "related": related(),
    }
    return rows.select(*findings.columns, *[v.alias(k) for k, v in made.items()])


def _first_calls(edges: DataFrame, methods: DataFrame, near: str, far: str, name: str) -> DataFrame:
    """(uid, name): up to five methods at the far end of each method's edges, by their id."""
    found = edges.select(F.col(near).alias("uid"), F.col(far).alias("other")).distinct()
    place = F.row_number().over(Window.partitionBy("uid").orderBy("other"))
    kept = found.withColumn("k", place).filter(F.col("k") <= MOST_CALLS)
    other = methods.select(F.col("uid").alias("other"), F.concat_ws(".", F.nullif("class_name", F.lit("")), "method_name").alias("method"), F.col("file_path").alias("file"), F.col("start_line").alias("line"))
    return kept.join(other, "other").groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", "method", "file", "line"))).alias(name))


def call_contexts(findings: DataFrame, methods: DataFrame, edges: DataFrame) -> DataFrame:
    """findings with uid, the method that contains each, and its callers and callees."""
    rows = containing(findings.withColumn("line", F.col("line_number")), methods)
    callers, callees = _first_calls(edges, methods, "callee_uid", "caller_uid", "callers"), _first_calls(edges, methods, "caller_uid", "callee_uid", "callees")
    joined = rows.join(callers, "uid", "left").join(callees, "uid", "left")
    return joined.select(*findings.columns, "uid", "callers", "callees")


def by_file(findings: DataFrame) -> DataFrame:
    """(file_path, keys): a file's findings together; as many as the file has lines and rules, which its size bounds."""
    key = fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_number"))
    return findings.groupBy("file_path").agg(F.array_sort(F.collect_set(key)).alias("keys"))
