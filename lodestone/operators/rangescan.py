"""Running values over ordered groups of any size: ranges are scanned side by side, and a small scan over their ends carries values on.

A window over a group runs in one task.  Here rows are sorted into ranges by
group and order, so that a group with half of all rows lies in many ranges.
Each range is scanned for itself; what the ranges before hold of the same group
is added after.  At most one group continues into a range, so no more rows
than ranges are carried, which is what bounds the broadcast.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.lineage import cut

_TOTAL = {
    "sum": lambda value, order: F.sum(value),
    "xor": lambda value, order: F.bit_xor(value),
    "last": lambda value, order: F.max_by(value, F.when(value.isNotNull(), order)),
}
_RUNNING = {"sum": F.sum, "xor": F.bit_xor, "last": lambda value: F.last(value, ignorenulls=True)}


def _merged(kind: str, before: Column, here: Column) -> Column:
    if kind == "last":
        return F.coalesce(here, before)
    both = before + here if kind == "sum" else before.bitwiseXOR(here)
    return F.coalesce(both, here, before)


def running(df: DataFrame, keys: list[str], order: list[Column | str], values: dict[str, tuple[str, Column]], ranges: int | None = None) -> DataFrame:
    """df with a column for each entry of values: its value over the rows of the same group up to and with this one.

    values: name to (kind, expression), the kind one of sum, xor (of whole
    numbers) and last (the last that is not null).  order: columns, or
    expressions with a direction.  Rows of a group that are equal in the order
    are taken in any order, each once, and lie in one range: give the order a
    last column that tells them apart where there may be very many.  Nulls in a
    key make a group of their own; an empty table gives an empty result.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorts = [F.col(o) if isinstance(o, str) else o for o in order]
    made = df.withColumns({f"__v_{k}": v for k, (_, v) in values.items()})
    placed = cut(made.repartitionByRange(n, *keys, *sorts).withColumn("__range", F.spark_partition_id()))
    lanes = {k: F.col(f"__v_{k}") for k in values}

    within = Window.partitionBy("__range", *keys).orderBy(*sorts).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"__r_{k}": _RUNNING[kind](lanes[k]).over(within) for k, (kind, _) in values.items()})

    # groups that may lie in several ranges: the first and the last of each
    group = F.struct(*keys)
    ends = placed.groupBy("__range").agg(F.min(group).alias("lo"), F.max(group).alias("hi")).select("__range", F.explode(F.array("lo", "hi")).alias("g"))
    spread = ends.groupBy("g").agg(F.countDistinct("__range").alias("n")).filter("n > 1").select("g.*")
    same = lambda left, right: reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])
    parts = placed.join(F.broadcast(spread), same(placed, spread), "left_semi")  # two rows a range at most
    last = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*sorts))
    parts = parts.withColumn("__place", last).groupBy("__range", *keys).agg(*[_TOTAL[kind](lanes[k], F.col("__place")).alias(k) for k, (kind, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(parts.select(F.col("__range").alias("__to"), *[_RUNNING[kind](F.col(k)).over(before).alias(f"__b_{k}") for k, (kind, _) in values.items()], *[F.col(k).alias(f"__k_{k}") for k in keys]))

    on = reduce(and_, [local[k].eqNullSafe(carried[f"__k_{k}"]) for k in keys], local["__range"] == carried["__to"])
    out = local.join(F.broadcast(carried), on, "left")  # as above
    return out.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], *[_merged(kind, F.col(f"__b_{k}"), F.col(f"__r_{k}")).alias(k) for k, (kind, _) in values.items()])
