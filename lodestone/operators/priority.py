"""Priorities, budgets and costs of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import mapped

# Weights of categories, multipliers of weaknesses, scores of severities, tokens and prices.
OWASP_WEIGHTS = {"A01": 10, "A02": 9, "A03": 9, "A04": 7, "A05": 6, "A06": 5, "A07": 8, "A08": 6, "A09": 4, "A10": 7}
CWE_MULTIPLIERS = {"CWE-89": 1.5, "CWE-78": 1.5, "CWE-79": 1.2, "CWE-22": 1.3, "CWE-798": 1.4, "CWE-502": 1.5, "CWE-918": 1.3, "CWE-352": 1.1, "CWE-327": 1.0, "CWE-862": 1.2}
SEVERITY_SCORES = {"critical": 100, "high": 75, "medium": 50, "low": 25, "info": 10}
TOKENS = {"explain": (1500, 800), "remediate": (2000, 1000), "false_positive": (1500, 500), "full": (3500, 2000)}
PRICE_PER_MILLION = (3.00, 15.00)
RISKS = ((80, "CRITICAL"), (60, "HIGH"), (40, "MEDIUM"), (20, "LOW"))


def prioritized(findings: DataFrame) -> DataFrame:
    """findings with priority_score and risk_level."""
    weight = mapped(F.col("owasp"), OWASP_WEIGHTS, 5)
    score = mapped(F.col("severity"), SEVERITY_SCORES, 50) * (0.4 + 0.6 * weight / 10) * mapped(F.col("cwe"), CWE_MULTIPLIERS, 1.0)
    rows = findings.withColumn("priority_score", F.round(score.cast("double"), 6))
    level = F.lit("INFO")
    for least, name in reversed(RISKS):
        level = F.when(F.col("priority_score") >= least, name).otherwise(level)
    return rows.withColumn("risk_level", level)


def top(findings: DataFrame, n: int, *ties: str) -> DataFrame:
    return prioritized(findings).orderBy(F.desc("priority_score"), *ties).limit(n)


def risk_groups(findings: DataFrame) -> DataFrame:
    """(risk_level, n): all five levels, with zeros."""
    names = [name for _, name in RISKS] + ["INFO"]
    levels = findings.sparkSession.createDataFrame([(x,) for x in names], "risk_level string")
    counts = prioritized(findings).groupBy("risk_level").agg(F.count(F.lit(1)).alias("c"))
    return levels.join(counts, "risk_level", "left").select("risk_level", F.coalesce("c", F.lit(0)).cast("long").alias("n"))


def unit_cost(kind: str, price: tuple[float, float] = PRICE_PER_MILLION) -> float:
    given, made = TOKENS[kind]
    return given / 1e6 * price[0] + made / 1e6 * price[1]


def cost(findings: DataFrame, kind: str = "full", price: tuple[float, float] = PRICE_PER_MILLION) -> DataFrame:
    """One row: findings, tokens read and written, and their price."""
    given, made = TOKENS[kind]
    n = F.count(F.lit(1))
    return findings.agg(n.alias("n_findings"), (n * given).alias("input_tokens"), (n * made).alias("output_tokens"), F.round(n * F.lit(unit_cost(kind, price)), 6).alias("total_cost"))


def within_budget(findings: DataFrame, budget: float, *ties: str, kind: str = "full", price: tuple[float, float] = PRICE_PER_MILLION) -> DataFrame:
    """The findings of highest priority whose summed cost stays within a budget.

    All cost the same, so that is a top-n: no running sum over all rows.
    """
    return top(findings, int((budget + 1e-12) // unit_cost(kind, price)), *ties)


def running_cost(findings: DataFrame, group: str, *ties: str, kind: str = "full") -> DataFrame:
    """findings of each group in order of priority, with the cost up to each."""
    order = Window.partitionBy(group).orderBy(F.desc("priority_score"), *ties).rowsBetween(Window.unboundedPreceding, 0)
    return prioritized(findings).withColumn("running_cost", F.round(F.sum(F.lit(unit_cost(kind))).over(order), 6))
