"""What a file's path and text say about it, and which findings that makes doubtful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.regex import any_of
from lodestone.functions.text import CONTEXT_LANGUAGES, basename, has_any, mapped, suffix

# Patterns of paths, of generated texts, and of findings that are no findings.
TEST_PATHS = [
    r"/test/", r"/tests/", r"/spec/", r"/specs/", r"/__tests__/", r"/testing/", r"/test_", r"_test\.", r"_spec\.", r"Test\.java$", r"Tests\.java$",
    r"test_.*\.py$", r".*_test\.py$", r".*_test\.go$", r"\.spec\.(js|ts)$", r"\.test\.(js|ts)$",
]
EXAMPLE_PATHS = [
    r"/example/", r"/examples/", r"/sample/", r"/samples/", r"/demo/", r"/demos/", r"/mock/", r"/mocks/", r"/fixture/", r"/fixtures/", r"/stub/", r"/stubs/",
    r"example\.", r"sample\.", r"demo\.",
]
GENERATED_TEXTS = [
    r"/generated/", r"/gen/", r"/build/", r"/dist/", r"/target/", r"/out/", r"\.generated\.", r"# Generated", r"// Generated", r"/* Generated",
    r"# AUTO-GENERATED", r"// AUTO-GENERATED", r"@Generated", r"@javax\.annotation\.Generated",
]
VENDOR_PATHS = [r"/vendor/", r"/node_modules/", r"/bower_components/", r"/third_party/", r"/thirdparty/", r"/external/", r"/lib/", r"/libs/", r"\.min\.(js|css)$"]
DOUBTS = {
    "secret": [
        r"//.*secret", r"#.*secret", r"/\*.*secret", r"\*.*secret", r"\'\'\'.*secret", r'""".*secret', r"secret_?name", r"secret_?id", r"secret_?type",
        r"has_?secret", r"is_?secret", r"use_?secret", r"def\s+.*secret", r"function\s+.*secret", r"public\s+.*\s+.*[Ss]ecret",
    ],
    "password": [
        r"password_?field", r"password_?input", r"password_?label", r"password_?placeholder", r"password_?hint", r"password_?policy", r"password_?strength",
        r"password_?hash", r"password_?encoder", r'["\']password["\']', r'name=["\']password', r"reset_?password", r"change_?password", r"forgot_?password",
    ],
    "sql-injection": [
        r"\$\{prefix\}", r"\$\{suffix\}", r"\$\{tableName\}", r"\$\{tablePrefix\}", r"\$\{schema\}", r"\$\{catalog\}",
        r"\$\{project\.", r"\$\{maven\.", r"\$\{gradle\.", r"\$\{java\.", r"\$\{user\.", r"\$\{env\.",
    ],
}
TEST_DATA = ("test", "mock", "fake", "dummy", "sample", "example", "fixture", "stub", "123456", "abcdef", "foobar", "lorem", "ipsum", "xxx", "yyy", "zzz")
CONFIG_NAMES = (
    "application.properties", "application.yml", "application.yaml", "config.yml", "config.yaml", "config.json", ".env", ".env.example", ".env.local", ".env.development",
    "settings.py", "settings.json", "docker-compose.yml", "docker-compose.yaml", "Dockerfile", "Jenkinsfile", "Makefile", "pom.xml", "build.gradle", "package.json",
    "requirements.txt", "Pipfile", "Gemfile",
)
SLASHED = ("java", "javascript", "typescript", "csharp", "go", "kotlin", "scala")
HASHED = ("python", "ruby", "yaml", "properties")


def framework(path: Column, content: Column) -> Column:
    """A framework that the path names, or else the first 5,000 characters import."""
    head = F.left(content, F.lit(5000))
    return (
        F.when(path.contains("spring") | path.contains("boot"), "spring")
        .when(basename(path).isin("application.properties", "application.yml", "application.yaml"), "spring")
        .when(path.contains("django") | path.contains("settings.py") | path.contains("urls.py") | path.contains("views.py"), "django")
        .when(path.contains("express") | (basename(path) == "app.js"), "express")
        .when(path.contains("laravel") | path.contains("artisan"), "laravel")
        .when(head.contains("org.springframework"), "spring")
        .when(head.contains("from django") | head.contains("import django"), "django")
        .when(head.contains("require('express')") | head.contains('from "express"'), "express")
    )


def file_context(files: DataFrame, *keep: str) -> DataFrame:
    """One row per file: test, example, configuration, generated, vendor, language and framework, and columns to keep."""
    path, content = F.col("path"), F.coalesce(F.col("content"), F.lit(""))
    return files.select(
        "path",
        any_of(path, TEST_PATHS).alias("is_test"),
        any_of(path, EXAMPLE_PATHS).alias("is_example"),
        basename(path).isin(*CONFIG_NAMES).alias("is_config"),
        ((content != "") & any_of(F.left(content, F.lit(2000)), GENERATED_TEXTS)).alias("is_generated"),
        any_of(path, VENDOR_PATHS).alias("is_vendor"),
        mapped(suffix(path), CONTEXT_LANGUAGES, "unknown").alias("language"),
        framework(F.lower(path), content).alias("framework"),
        *keep,
    )


def commented(line: Column, language: Column) -> Column:
    """Whether a line begins as a comment of its language."""
    text = F.trim(line)
    slash = text.startswith("//") | text.startswith("/*") | text.startswith("*")
    return (language.isin(*SLASHED) & slash) | (language.isin(*HASHED) & text.startswith("#")) | ((language == "xml") & text.startswith("<!--"))


def doubtful(around: Column) -> Column:
    """The false-positive predicate over findings with their file's context and the lines around them."""
    snippet = F.coalesce(F.col("snippet"), F.lit(""))
    out = F.lit(False)
    for tag, patterns in DOUBTS.items():
        out = out | (F.array_contains("tags", tag) & (any_of(snippet, patterns) | any_of(around, patterns)))
    out = out | (commented(snippet, F.col("language")) & F.col("severity").isin("low", "medium"))
    secret = F.array_contains("tags", "credentials") | F.array_contains("tags", "secret")
    return out | (F.col("is_test") & secret & has_any(snippet, TEST_DATA)) | F.col("is_example") | F.col("is_generated") | F.col("is_vendor")


def with_context(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings less the doubtful ones, with confidence lowered in tests and examples.

    Findings join their file's path flags and its text, once.
    """
    flags = ["is_test", "is_example", "is_generated", "is_vendor"]
    context = file_context(files, "content").withColumnRenamed("path", "file_path")
    joined = findings.join(context, "file_path", "left").fillna({f: False for f in flags} | {"language": "unknown", "content": ""})
    lines = F.split("content", "\n", -1)
    first = F.greatest(F.col("line_number") - 3, F.lit(1))
    around = F.when(F.col("content") == "", "").otherwise(F.array_join(F.slice(lines, first, F.col("line_number") + 4 - first), "\n"))
    stepped = F.when(F.col("is_test"), F.when(F.col("confidence") == "high", "medium").otherwise("low")).otherwise(F.col("confidence"))
    confidence = F.when(F.col("is_example"), "low").otherwise(stepped)
    return joined.filter(~doubtful(around)).withColumn("confidence", confidence).select(*findings.columns)
