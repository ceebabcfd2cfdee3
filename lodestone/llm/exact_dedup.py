"""Exact deduplication by progressive refinement.

Rows are grouped by the length of their normal form, rows of a shared length
by a hash of its first characters, and only rows whose (length, prefix) is
shared have their full content hashed.  What is shuffled is a few bytes a row,
never a text; the keys that survive the prefix level go back to the text scan
by a broadcast when they are counted to be few, else by a shuffle join.  Group
summaries are pre-aggregated before their shuffle, so a group with a third of
all rows is one small row a task, and written before they are joined back, so
that adaptive execution can split a hot group's rows (it does not split a join
with an aggregate of the same stage).

Defined cases: a null text counts as empty; texts of white space only are
equal to each other; a null id loses ties to any id; of rows repeated with the
same id and text one stays; columns named like the added ones are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_bounded, discard, quoted, text_or_empty, without, written

PREFIX_CHARS = 256
ADDED = ("keep_id", "group_size", "kept")


def normal_form(text: str | Column) -> Column:
    """The text less all ASCII white space."""
    return F.regexp_replace(text_or_empty(text), SPACE, "")


def _shared_keys(docs: DataFrame, norm: Column, prefix_chars: int) -> tuple[DataFrame, Column]:
    """Keys of (length, prefix hash) that two rows or more share, and the key as an expression on docs."""
    length = F.length(norm)
    key = F.xxhash64(length, F.substring(norm, 1, prefix_chars))
    signatures = written(docs.select(length.alias("__length"), key.alias("__key")), "dedup-signatures")
    lengths = signatures.groupBy("__length").count().filter("count > 1").select("__length")
    by_length = signatures.join(lengths, "__length", "left_semi")
    shared = written(by_length.groupBy("__key").count().filter("count > 1").select("__key"), "dedup-prefixes")
    discard(signatures)
    return shared, key


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Every row with its group of equal texts.

    Returns the columns in ``carry`` (all but the text by default) and keep_id
    (id of the row that stays: most code points in the original text, then the
    smallest id), group_size and kept.
    """
    docs = without(docs, *[n for n in ADDED if n.lower() not in (id_col.lower(), text_col.lower())])
    carry = [c for c in (carry or docs.columns) if carry or c != text_col]
    norm = normal_form(quoted(text_col))
    shared, key = _shared_keys(docs, norm, prefix_chars)
    scan = docs.withColumns({"__key": key, "__chars": F.length(text_or_empty(quoted(text_col)))})
    scan = scan.join(broadcast_if_bounded(shared.withColumn("__shared", F.lit(True))), "__key", "left")
    full = F.when(F.col("__shared"), F.sha2(norm.cast("binary"), 256))
    rows = written(
        scan.select(F.monotonically_increasing_id().alias("__row"), F.col(quoted(id_col)).alias("__id"), "__chars", full.alias("__hash"), F.struct(*[quoted(c) for c in carry]).alias("__carried")),
        "dedup-rows",
    )
    discard(shared)
    suspects = rows.filter("__hash IS NOT NULL")
    best = F.struct((-F.col("__chars")).alias("c"), F.col("__id").isNull().alias("n"), F.col("__id").alias("id"), F.col("__row").alias("row"))
    # a table of its own: both sides of the join are plain shuffles then, of which a hot group's can be split
    summary = written(suspects.groupBy("__hash").agg(F.min(best).alias("__best"), F.count(F.lit(1)).alias("__size")), "dedup-groups-summary")
    joined = suspects.join(summary, "__hash").select("__carried", F.col("__best.id").alias("keep_id"), F.col("__size").alias("group_size"), (F.col("__best.row") == F.col("__row")).alias("kept"))
    alone = rows.filter("__hash IS NULL").select("__carried", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(joined).select("__carried.*", *ADDED)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows that stay, with all their columns; texts are not shuffled while the dropped keys are few."""
    identity = {"__id": F.col(quoted(id_col)), "__content": F.xxhash64(text_or_empty(quoted(text_col)))}
    groups = written(exact_groups(docs.withColumns(identity), "__id", text_col, ["__id", "__content"], prefix_chars), "dedup-groups")
    dropped = groups.groupBy("__id", "__content").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    gone = written(dropped.filter("NOT stays").select("__id", "__content"), "dedup-dropped")
    repeated = dropped.filter("stays AND n > 1").select("__id", "__content")
    repeats = written(repeated, "dedup-repeats")
    discard(groups)
    left = docs.withColumns(identity)
    out = drop_keys(left, gone)
    if repeats.isEmpty():
        return out.select(*[quoted(c) for c in docs.columns])
    once = out.join(broadcast_if_bounded(repeats.withColumnsRenamed({"__id": "__i", "__content": "__c"})), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__content") == F.col("__c")), "left_semi")
    return drop_keys(out, repeats).unionByName(once.dropDuplicates(["__id", "__content"])).select(*[quoted(c) for c in docs.columns])


def drop_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows less those whose (__id, __content) is in keys (a written table)."""
    keys = broadcast_if_bounded(keys.select(F.col("__id").alias("__i"), F.col("__content").alias("__c")))
    return rows.join(keys, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__content") == F.col("__c")), "left_anti")
