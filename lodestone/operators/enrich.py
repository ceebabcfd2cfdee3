"""Findings enriched by a text model behind a provider interface, with a cache table and its statistics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import parsed_reply, severity_rank, template
from lodestone.operators.findings import FOUND as _FOUND
from lodestone.operators.findings import at_least
from lodestone.operators.ledger import Ledger
from lodestone.operators.lineage import cut
from lodestone.operators.snippets import with_snippets

VERDICT = "is_false_positive boolean, confidence string, explanation string"
#: What models are asked, by kind of question: own wording; $names are filled in.
SYSTEM = "You review source code for security. Judge from what is shown, say how sure you are, and answer with JSON only."
_FINDING = "Finding $rule_id ($rule_name), severity $severity, weakness $cwe, in $file_path at line $line:\n$code\n$context\n"
TEMPLATES = {
    "explain": _FINDING + "Explain it as JSON with summary, explanation, attack_vector, impact, exploitability, confidence and confidence_reasoning.",
    "remediate": _FINDING + "Propose a fix as JSON with primary_fix (description, code, explanation), alternative_fixes, prevention, testing and references.",
    "false_positive": _FINDING + "Is it real? Answer as JSON with verdict (true_positive, false_positive or uncertain), confidence, reasoning, evidence, mitigating_factors and recommendation.",
    "batch": "Findings:\n$findings\nCode:\n$code\nRank them as JSON with findings (id, verdict, adjusted_severity, priority_rank, brief_explanation) and summary.",
    "review": "Review $file_path ($language) for $focus:\n$code\nAnswer as JSON with findings, positive_observations, overall_risk and summary.",
    "dataflow": "Does $source_variable ($source_type, $source_location) reach the $sink_type at $sink_location?\n$code\nAnswer as JSON with tainted_flow_exists, confidence, flow_description, sanitization_present, is_exploitable and recommendation.",
    "spring": "Review this security configuration:\n$code\nEndpoints:\n$endpoints\nApplication:\n$context\nAnswer as JSON with issues, authentication_assessment, authorization_assessment, csrf_status, cors_status and overall_security_posture.",
    "mapper": "Is statement $statement_id ($statement_type, parameters $parameters) of $file_path open to injection?\n$code\nAnswer as JSON with vulnerable, vulnerability_type, confidence, vulnerable_parameters, safe_parameters, explanation and fix.",
}
#: Kinds that are asked of single findings.
KINDS = ("explain", "remediate", "false_positive")
JUDGED = "verdict string, confidence string, reasoning string"
#: Characters that a token has on average, where a provider does not count tokens.
TOKEN_CHARS = 4
PROMPT = "Finding $rule_id ($severity) in $file_path at line $line:\n$code\nIs it a false positive? Answer as JSON."


def prompts(findings: DataFrame, files: DataFrame, around: int = 10) -> DataFrame:
    """findings with the prompt of each, and its cache key; of each file only the lines around findings move, once."""
    rows = with_snippets(findings, files, around)
    text = template(PROMPT, {"rule_id": F.col("rule_id"), "severity": F.col("severity"), "file_path": F.col("file_path"), "line": F.col("line_number").cast("string"), "code": F.col("code")})
    return rows.withColumn("prompt", text).drop("code").withColumn("cache_key", F.left(F.sha2(F.to_json(F.struct("prompt")), 256), F.lit(16)))


def asked(cases: DataFrame, kind: str) -> DataFrame:
    """Findings with their contexts (see casefile) as prompts of a kind, with cache keys."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    context = F.concat_ws("\n", F.array_join("imports", "\n"), "class_context", "method_context", F.array_join("annotations", ", "), "framework_context")
    values = {c: some(c) for c in ("rule_id", "rule_name", "severity", "cwe", "file_path", "code")} | {"line": some("line_number"), "context": context}
    rows = cases.withColumn("prompt", F.concat(F.lit(SYSTEM + "\n"), template(TEMPLATES[kind], values)))
    return rows.withColumn("cache_key", F.left(F.sha2(F.to_json(F.struct("prompt")), 256), F.lit(16)))


def candidates(findings: DataFrame, severity: str = "high", most: int = 20) -> DataFrame:
    """The findings worth asking about: of a severity or worse, the worst first, then as they were found."""
    return at_least(findings, severity).orderBy(severity_rank(F.col("severity")).desc(), *_FOUND, "file_path", "line_number").limit(most)


def first_ranked(findings: DataFrame, most: int = 50) -> DataFrame:
    """The first findings as they were found, and of these the worst first."""
    return findings.orderBy(*_FOUND, "file_path", "line_number").limit(most).orderBy(severity_rank(F.col("severity")).desc(), *_FOUND, "file_path", "line_number")


def retried(provider: Callable[[pd.Series], pd.Series], attempts: int = 3, delay: float = 1.0) -> Callable[[pd.Series], pd.Series]:
    """A provider that is asked again after twice the time each time it raises, and raises after the last attempt."""

    def ask(texts: pd.Series) -> pd.Series:
        for k in range(attempts):
            try:
                return provider(texts)
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(delay * 2**k)
        raise ValueError("attempts must be at least 1")

    return ask


def save(replies: DataFrame, path: str) -> None:
    """Append what the provider answered to a cache table."""
    replies.filter("NOT cached").select("cache_key", "reply").dropDuplicates(["cache_key"]).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """A cache table; empty where there is none yet."""
    try:
        return spark.read.schema("cache_key string, reply string").parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], "cache_key string, reply string")


def clear(spark: SparkSession, path: str) -> None:
    """Empty a cache table."""
    spark.createDataFrame([], "cache_key string, reply string").write.mode("overwrite").parquet(path)


def verdicts(replies: DataFrame) -> DataFrame:
    """One row: answers that judge findings as real, as false or as uncertain, and the share of false ones as a text."""
    judged = replies.withColumn("v", parsed_reply(F.col("reply"), JUDGED)["verdict"])
    n, false = F.count(F.lit(1)), F.count_if(F.col("v") == "false_positive")
    share = F.when(n > 0, F.concat(F.format_number(100.0 * false / n, 1), F.lit("%"))).otherwise("0%")
    return judged.agg(n.alias("total_analyzed"), F.count_if(F.col("v") == "true_positive").alias("true_positives"), false.alias("false_positives"), F.count_if(F.col("v") == "uncertain").alias("uncertain"), share.alias("false_positive_rate"))


def stub_provider(texts: pd.Series) -> pd.Series:
    """A provider for tests, without a model: a fixed verdict per prompt."""
    return texts.map(lambda p: '```json\n{"is_false_positive": %s, "confidence": "high", "explanation": "stub"}\n```' % ("true" if len(p) % 2 else "false"))


def answered(asked: DataFrame, provider: Callable[[pd.Series], pd.Series], cache: DataFrame | None = None, ledger: Ledger | None = None) -> DataFrame:
    """asked with reply, latency_ms and cached: from the cache table (cache_key, reply) or the ledger where they have the key, else from the provider.

    The provider is asked at once and once for each key, whatever is done with
    the result; rows of one key share its answer.  With a ledger, answers
    outlive the job and a failed task (see there); without, they are a table of
    this session.
    """
    known = asked.select("cache_key", F.lit(None).cast("string").alias("old")).limit(0) if cache is None else cache.select("cache_key", F.col("reply").alias("old")).dropDuplicates(["cache_key"])
    joined = asked.join(known, "cache_key", "left")
    old = joined.filter("old IS NOT NULL").withColumnRenamed("old", "reply").withColumns({"cached": F.lit(True), "latency_ms": F.lit(0.0)})
    rest = joined.filter("old IS NULL").drop("old")
    if ledger is not None:
        new_keys = ledger.ask(rest.select("cache_key", "prompt"), provider).withColumn("fresh", F.lit(True))
        replies = ledger.replies().join(new_keys, "cache_key", "left")
    else:
        replies = _asked_once(rest, provider).withColumn("fresh", F.lit(True))
    new = rest.join(replies, "cache_key").withColumn("cached", F.col("fresh").isNull()).drop("fresh")
    return old.unionByName(new.withColumn("latency_ms", F.when(F.col("cached"), 0.0).otherwise(F.col("latency_ms"))))


def _asked_once(rest: DataFrame, provider: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """(cache_key, reply, latency_ms) of the distinct keys, as a table that later actions read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            begun = time.perf_counter()
            reply = provider(batch["prompt"])
            yield pd.DataFrame({"cache_key": batch["cache_key"], "reply": reply, "latency_ms": 1000 * (time.perf_counter() - begun) / max(1, len(batch))})

    keys = cut(rest.groupBy("cache_key").agg(F.min("prompt").alias("prompt")))
    return cut(keys.mapInPandas(run, "cache_key string, reply string, latency_ms double"))


def enhanced(replies: DataFrame) -> DataFrame:
    """Verdicts parsed, with the severity that follows: likely false positives become info or low."""
    v = parsed_reply(F.col("reply"), VERDICT)
    rows = replies.withColumn("verdict", v)
    severity = F.when(F.col("verdict.is_false_positive") & (F.col("verdict.confidence") == "high"), "info").when(F.col("verdict.is_false_positive"), "low").otherwise(F.col("severity"))
    return rows.withColumn("adjusted_severity", severity).withColumn("parse_error", F.col("verdict").isNull())


def usage(replies: DataFrame, price_in: float = 3.0, price_out: float = 15.0) -> DataFrame:
    """One row: replies, those from the cache and its share, and of the others tokens, mean latency and cost (dollars for a million tokens)."""
    tokens = lambda c: F.coalesce(F.sum(F.when(~F.col("cached"), F.ceil(F.length(c) / TOKEN_CHARS))), F.lit(0)).cast("long")
    given, made = tokens("prompt"), tokens("reply")
    return replies.agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("cached").alias("cache_hits"), F.round(F.count_if("cached") / F.count(F.lit(1)), 6).alias("hit_rate"), given.alias("input_tokens"), made.alias("output_tokens"),
        F.coalesce(F.avg(F.when(~F.col("cached"), F.col("latency_ms"))), F.lit(0.0)).alias("mean_latency_ms"), F.round(given * price_in / 1e6 + made * price_out / 1e6, 6).alias("cost"),
    )
