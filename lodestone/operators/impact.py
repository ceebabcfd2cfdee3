"""What a finding may lead to: by its weakness, else by a tag, else by its severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import mapped

#: Own wording; callers may give their own tables.
BY_CWE = {
    "CWE-89": "Queries run that the application did not mean; data can be read, changed or removed.",
    "CWE-78": "Commands run on the host with the application's rights.",
    "CWE-22": "Files outside the intended folder can be read or written.",
    "CWE-79": "Scripts of a stranger run in visitors' browsers.",
    "CWE-918": "The server can be made to call internal addresses.",
    "CWE-502": "Objects from a stranger can run code when they are read.",
    "CWE-862": "Functions are open to those who should not use them.",
    "CWE-863": "Checks let through those whom they should stop.",
    "CWE-639": "By another's identifier, another's data can be reached.",
    "CWE-532": "Whoever reads the logs reads what should be secret.",
    "CWE-798": "Whoever reads the source holds the credentials.",
    "CWE-327": "Weak ciphers or digests can be broken.",
    "CWE-328": "Weak digests can be reversed or made to collide.",
    "CWE-352": "A visitor's browser can be made to act for them.",
    "CWE-942": "Other sites can read answers meant for this one.",
    "CWE-16": "Settings leave the application open.",
    "CWE-330": "Values that should be secret can be guessed.",
}
BY_TAG = {
    "sql-injection": "Database queries can be altered.",
    "command-injection": "Host commands can be altered.",
    "path-traversal": "Files elsewhere on the host can be reached.",
    "xss": "Scripts can be put into pages.",
    "ssrf": "Internal services can be called.",
    "idor": "Another's records can be reached.",
    "logging": "Logs hold what they should not.",
    "sensitive-data": "Data that should be protected are exposed.",
    "authentication": "Others can pass for a user.",
    "authorization": "Users can do what they should not.",
    "csrf": "Requests can be forged.",
    "cors": "Other sites can read answers.",
    "secrets": "Secrets are exposed.",
    "credentials": "Credentials are exposed.",
    "secret": "Secrets are exposed.",
    "deserialization": "Untrusted objects are read.",
    "crypto": "Encryption or digests can be broken.",
    "spring": "The framework's protection is weakened.",
    "mybatis": "Mapped statements can be altered.",
    "security-config": "Security settings let too much through.",
    "config": "The configuration weakens other protection.",
    "missing-validation": "Unchecked input reaches the application.",
    "validation": "Unchecked input reaches the application.",
}
BY_SEVERITY = {"critical": "Needs attention at once.", "high": "Needs attention soon.", "medium": "Needs attention in time.", "low": "Small risk.", "info": "For information."}


def impact(cwe: Column, tags: Column, severity: Column, by_cwe: dict | None = None, by_tag: dict | None = None) -> Column:
    """The first of: the weakness's text, the text of a tag as it is, that of a tag that is part of a key or has a key as a part, the severity's."""
    table = by_tag or BY_TAG
    keys = F.array(*map(F.lit, table))
    exact = F.transform(F.filter(tags, lambda t: F.array_contains(keys, t)), lambda t: t)
    partial = F.filter(F.flatten(F.transform(tags, lambda t: F.filter(keys, lambda k: t.contains(k) | k.contains(t)))), lambda k: k.isNotNull())
    key = F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(partial, F.lit(1)))
    return F.coalesce(mapped(cwe, by_cwe or BY_CWE), mapped(key, table), mapped(severity, BY_SEVERITY))


def with_impact(findings: DataFrame) -> DataFrame:
    return findings.withColumn("impact", impact(F.col("cwe"), F.coalesce("tags", F.array().cast("array<string>")), F.col("severity")))
