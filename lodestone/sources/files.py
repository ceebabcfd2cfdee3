"""Source files as a table, and the rules of which files a scan reads."""

from __future__ import annotations

import os
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.regex import glob
from lodestone.functions.text import CONTEXT_LANGUAGES, basename, mapped, suffix
from lodestone.sources import tree

# What a scan reads and what it passes over.
EXTENSIONS = (
    ".java", ".kt", ".kts", ".scala", ".gradle", ".js", ".ts", ".jsx", ".tsx", ".vue", ".php", ".py", ".rb", ".rake", ".gemspec", ".erb", ".go", ".rs",
    ".swift", ".cs", ".cshtml", ".xml", ".properties", ".yml", ".yaml", ".json", ".env", ".config", ".conf", ".tf", ".tfvars", ".graphql", ".gql", ".proto", ".html", ".htm",
)
NAMES = ("Dockerfile", "Jenkinsfile", "Makefile")
SKIP_DIRECTORIES = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".idea", ".vscode", "target", "build", "dist", "out",
    "vendor", "venv", ".venv", "env", ".env", ".gradle", ".mvn", "bin", "obj",
)
SKIP_NAMES = (".gitignore", ".dockerignore", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "composer.lock", "Gemfile.lock")
MAX_BYTES = 10 * 1024 * 1024


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 if they are valid, else Latin-1; line ends become line feeds."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


def from_table(table: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The files table of a table of paths and texts; a null text is empty."""
    text = F.coalesce(F.col(content), F.lit(""))
    return table.select(F.col(path).alias("path"), text.alias("content")).select(
        "path", basename(F.col("path")).alias("name"), suffix(F.col("path")).alias("ext"), F.octet_length("content").cast("long").alias("size"),
        mapped(suffix(F.col("path")), CONTEXT_LANGUAGES, "unknown").alias("language"), "content",
    )


def selected(path: Column, size: Column, root: str = "", excludes: list[str] | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    """Whether a scan of ``root`` reads a file."""
    below = F.substr(path, F.lit(len(root) + 1)) if root else path
    folders = F.slice(F.split(F.regexp_replace(below, "^/+", ""), "/"), F.lit(1), F.greatest(F.size(F.split(F.regexp_replace(below, "^/+", ""), "/")) - 1, F.lit(0)))
    keep = ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRECTORIES))) | (F.size(folders) == 0)
    keep = keep & ~basename(path).isin(*SKIP_NAMES) & (suffix(path).isin(*extensions) | basename(path).isin(*NAMES)) & (size <= MAX_BYTES)
    for pattern in excludes or ():
        keep = keep & ~excluded(path, pattern)
    return keep


def excluded(path: Column, pattern: str) -> Column:
    """``dir/`` is a folder of the path, a glob matches anywhere in it, anything else is a part of it."""
    if pattern.endswith("/"):
        return path.contains("/" + pattern) | path.startswith(pattern)
    if "*" in pattern or "?" in pattern:
        return path.rlike(glob(f"*{pattern}*"))
    return path.contains(pattern)


def ignore_patterns(lines: DataFrame) -> list[str]:
    """Patterns of an ignore file: a few lines, without blanks and comments."""
    text = F.trim(F.col("value"))
    return [r[0] for r in lines.select(text.alias("p")).filter("p <> '' AND NOT startswith(p, '#')").collect()]


def local_root(root: str) -> str:
    """A folder's absolute path, without a scheme."""
    return os.path.abspath(re.sub("^file:/*", "/", root))


def from_tree(spark: SparkSession, root: str, excludes: list[str] | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """The files below a folder, or one file, whatever their names begin with; see sources/tree.py.

    Folders that a scan passes over are not entered, and names, sizes and
    excludes are judged before a file is read.  A file that cannot be read has
    an empty text.
    """
    settings = {"skip_directories": SKIP_DIRECTORIES, "skip_names": SKIP_NAMES, "extensions": extensions, "names": NAMES, "excludes": list(excludes or ()), "max_bytes": MAX_BYTES}
    raw = tree.read(spark, local_root(root), settings)
    return from_table(raw.select("path", decoded(F.col("content")).alias("content")))


def git_paths(spark: SparkSession, repository: str, base: str | None = None, staged: bool = False) -> DataFrame:
    """Paths that git names: staged, changed since a base, or all tracked."""
    command = ["git", "-C", repository, *(["diff", "--cached", "--name-only", "--diff-filter=ACMR", "-z"] if staged else ["diff", "--name-only", "-z", f"{base}...HEAD"] if base else ["ls-files", "-z"])]
    names = subprocess.run(command, capture_output=True, check=True).stdout.decode("utf-8", "surrogateescape").split("\0")
    return spark.createDataFrame([(n,) for n in names if n], "path string")


# Files that a hook scans.
HOOK_EXTENSIONS = (".java", ".py", ".js", ".ts", ".jsx", ".tsx", ".xml", ".yaml", ".yml", ".json", ".properties", ".sql", ".sh", ".bash", ".go", ".rb", ".php")


def scannable(files: DataFrame, paths: DataFrame, root: str = "") -> DataFrame:
    """The files that are there of those that a change names, relative to the root, if a hook scans their kind."""
    before = root.rstrip("/") + "/" if root else ""
    given = paths.select(F.concat(F.lit(before), F.col("path")).alias("path")).distinct()
    return files.filter(F.col("ext").isin(*HOOK_EXTENSIONS)).join(given, "path", "left_semi")


def changed(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings in files that a path names, whole or as the end of their own path."""
    given = paths.select(F.col("path").alias("changed"), F.element_at(F.split("path", "/"), -1).alias("n")).distinct()
    match = (basename(F.col("file_path")) == F.col("n")) & ((F.col("file_path") == F.col("changed")) | F.col("file_path").endswith(F.concat(F.lit("/"), F.col("changed"))))
    return findings.join(given, match, "left_semi")
