"""Methods, calls and the call graph of source files, and walks over it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.regex import java, matches
from lodestone.functions.text import class_guess
from lodestone.operators.graph import ancestors
from lodestone.operators.lineage import cut
from lodestone.operators.rangescan import running

# Headers of classes and methods, calls, and words that only look like them.
CLASS = java(r"\b(?:class|interface|enum)\s+(\w+)")
JAVA_METHOD = java(r"(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)+(?:<[^>]+>\s+)?([\w<>\[\], .?]+?)\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w., ]+)?\s*\{")
PYTHON_METHOD = java(r"(?m)^[ \t]*(?:async[ \t]+)?def()[ \t]+(\w+)[ \t]*\(([^)]*)\)")
CALL = java(r"(?:([\w.]+)\.)?\b(\w+)\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)")
NO_CALLS = ("if", "for", "while", "switch", "catch", "return", "new", "synchronized", "def", "class", "print", "super", "this")
#: A walk's longest chain.
MAX_DEPTH = 10
#: Rounds after which the tables they have added are made one.
CUT_ROUNDS = 16


def methods(files: DataFrame) -> DataFrame:
    """(uid, file_path, class_name, method_name, start_line, end_line, params) of Java and Python files.

    A method ends where the next one of its file begins.
    """
    content = F.col("content")
    found = F.when(F.col("ext") == ".java", matches(content, JAVA_METHOD)).otherwise(matches(content, PYTHON_METHOD))
    pattern = lambda k: F.when(F.col("ext") == ".java", F.regexp_extract("m.matched", JAVA_METHOD, k)).otherwise(F.regexp_extract("m.matched", PYTHON_METHOD, k))
    rows = files.filter(F.col("ext").isin(".java", ".py")).select("path", "ext", F.split(content, "\n", -1).alias("lines"), matches(content, CLASS).alias("classes"), F.posexplode(found).alias("i", "m"))
    owner = F.filter("classes", lambda c: c["line"] <= F.col("m.line"))
    name = F.coalesce(F.regexp_extract(F.try_element_at(owner, F.lit(-1))["matched"], CLASS, 1), F.lit(""))
    ends = Window.partitionBy("path").orderBy("i")
    params = F.filter(F.transform(F.split(pattern(3), ","), lambda x: F.element_at(F.split(F.trim(F.regexp_replace(x, "[=:].*$", "")), r"\s+"), -1)), lambda x: x != "")
    rows = rows.select("path", "i", F.size("lines").alias("n"), name.alias("class_name"), pattern(2).alias("method_name"), F.col("m.line").alias("start_line"), params.alias("params"))
    uid = F.concat_ws(":", "path", F.concat_ws(".", F.when(F.col("class_name") != "", F.col("class_name")), "method_name"), F.col("start_line").cast("string"))
    return rows.select(uid.alias("uid"), F.col("path").alias("file_path"), "class_name", "method_name", "start_line", (F.coalesce(F.lead("start_line").over(ends), F.col("n") + 1) - 1).cast("int").alias("end_line"), "params")


def containing(events: DataFrame, found: DataFrame, line: str = "line") -> DataFrame:
    """As-of join: each event of a file with the last method that begins at or before its line, as uid (null before the first).

    Methods and events lie on one line, which is scanned in ranges, so a file
    with very many events is the work of many tasks.
    """
    marks = found.select("file_path", F.col("start_line").alias("__at"), F.lit(0).alias("__kind"), F.struct("uid").alias("__method"))
    rest = [c for c in events.columns if c != "file_path"]
    both = marks.withColumn("__event", F.lit(None).cast(events.select(F.struct(*rest)).schema[0].dataType)).unionByName(
        events.select("file_path", F.col(line).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast("struct<uid:string>").alias("__method"), F.struct(*rest).alias("__event"))
    )
    last = running(both, ["file_path"], ["__at", "__kind"], {"__last": ("last", F.col("__method"))})
    return last.filter("__kind = 1").select("file_path", "__event.*", F.col("__last.uid").alias("uid"))


def calls(files: DataFrame, found: DataFrame) -> DataFrame:
    """(call_id, file_path, line, callee_name, callee_object, args, text, uid): calls with the method they are in."""
    rows = files.filter(F.col("ext").isin(".java", ".py")).select(F.col("path").alias("file_path"), F.posexplode(matches(F.col("content"), CALL)).alias("i", "m"))
    part = lambda k: F.regexp_extract("m.matched", CALL, k)
    args = F.filter(F.transform(F.split(part(3), ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select(
        F.concat_ws("#", "file_path", F.col("i").cast("string")).alias("call_id"), "file_path", F.col("m.line").alias("line"), part(2).alias("callee_name"), part(1).alias("callee_object"), args.alias("args"), F.col("m.matched").alias("text")
    ).filter(~F.col("callee_name").isin(*NO_CALLS))
    heads = found.select("file_path", F.col("start_line").alias("line"), F.col("method_name").alias("callee_name"))
    rows = rows.join(heads, ["file_path", "line", "callee_name"], "left_anti")  # a header is no call
    return containing(rows, found).filter("uid IS NOT NULL")


def resolved(sites: DataFrame, found: DataFrame) -> DataFrame:
    """(call_id, caller_uid, callee_uid): a call's method by name: the only one, else the only one of its file, else of the class its receiver names, else the first.

    Candidates are summed up per name, file and class before they join, so a
    name that very many methods have makes one row and not many.
    """
    first = F.min("uid").alias("first")
    only = lambda keys: found.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n"))
    by_name = only(["method_name"]).withColumnsRenamed({"first": "a", "n": "an"})
    by_file = only(["method_name", "file_path"]).withColumnsRenamed({"first": "b", "n": "bn"})
    by_class = only(["method_name", "class_name"]).withColumnsRenamed({"first": "c", "n": "cn"})
    rows = sites.withColumn("method_name", F.col("callee_name")).withColumn("class_name", class_guess(F.col("callee_object")))
    rows = rows.join(by_name, "method_name").join(by_file, ["method_name", "file_path"], "left").join(by_class, ["method_name", "class_name"], "left")
    target = F.when(F.col("an") == 1, F.col("a")).when(F.col("bn") == 1, F.col("b")).when(F.col("cn") == 1, F.col("c")).otherwise(F.col("a"))
    return rows.select("call_id", F.col("uid").alias("caller_uid"), target.alias("callee_uid"))


def edges(links: DataFrame) -> DataFrame:
    return links.select("caller_uid", "callee_uid").distinct()


def reached(graph: DataFrame, starts: DataFrame, depth: int | None = MAX_DEPTH, reverse: bool = False) -> DataFrame:
    """(start, node, depth, path): every node a start reaches, by its first visit: the least depth, then the least path.

    Each step joins the frontier to the edges and drops what was visited; the
    visited table is checkpointed, so plans stay short.  Without a depth the
    walk ends when nothing is new.
    """
    a, b = ("callee_uid", "caller_uid") if reverse else ("caller_uid", "callee_uid")
    links = cut(graph.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    seen = starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.array("start").alias("path"))
    frontier = seen
    for k in count(1) if depth is None else range(1, depth + 1):
        step = frontier.join(links, "node").select("start", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"))
        new = step.groupBy("start", "node").agg(F.min("path").alias("path")).join(seen, ["start", "node"], "left_anti").select("start", "node", F.lit(k).alias("depth"), "path")
        frontier = cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if k % CUT_ROUNDS == 0:
            seen = cut(seen)
    return seen


def chains(graph: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH, reverse: bool = False) -> DataFrame:
    """Paths of a walk that end at a node without further edges or at the depth."""
    a = "callee_uid" if reverse else "caller_uid"
    leaves = graph.select(F.col(a).alias("node")).distinct()
    found = reached(graph, starts, depth, reverse)
    inner = found.join(leaves, "node", "left_semi").filter(F.col("depth") < depth).select("start", "node")
    return found.join(inner, ["start", "node"], "left_anti")


def superclasses(hierarchy: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth) up a (child, parent) table, to the root, in as many rounds as the depth has binary digits."""
    return ancestors(hierarchy.select("child", "parent"), starts).filter("depth > 0")


def stats(found: DataFrame, graph: DataFrame) -> DataFrame:
    """One row: methods, edges, classes and files."""
    one = found.agg(F.count(F.lit(1)).alias("methods"), F.countDistinct("class_name").alias("classes"), F.countDistinct("file_path").alias("files"))
    return one.crossJoin(graph.agg(F.count(F.lit(1)).alias("edges")))  # one row each


def calling(graph: DataFrame, uid: str, reverse: bool = False) -> DataFrame:
    """Methods that a method calls, or with reverse those that call it."""
    a, b = ("callee_uid", "caller_uid") if reverse else ("caller_uid", "callee_uid")
    return graph.filter(F.col(a) == uid).select(F.col(b).alias("uid")).distinct()

