"""The taint lattice: values of a level, labels and cleared sinks, joined and met by set expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels from bottom to top.
LEVELS = {"bottom": 0, "untainted": 1, "sanitized": 2, "tainted": 3, "top": 4}
TYPE = "struct<level:int,labels:array<string>,sanitized_for:array<string>>"


def value(level: Column, labels: Column, sanitized_for: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), F.array_sort(labels).alias("labels"), F.array_sort(sanitized_for).alias("sanitized_for"))


def join(a: Column, b: Column) -> Column:
    """Least upper bound: the higher level, all labels, and the sinks both are cleared for; bottom changes nothing."""
    both = value(F.greatest(a["level"], b["level"]), F.array_union(a["labels"], b["labels"]), F.array_intersect(a["sanitized_for"], b["sanitized_for"]))
    return F.when(a["level"] == 0, b).when(b["level"] == 0, a).otherwise(both)


def meet(a: Column, b: Column) -> Column:
    """Greatest lower bound: the lower level, shared labels, and the sinks either is cleared for; top changes nothing."""
    both = value(F.least(a["level"], b["level"]), F.array_intersect(a["labels"], b["labels"]), F.array_union(a["sanitized_for"], b["sanitized_for"]))
    return F.when(a["level"] == 4, b).when(b["level"] == 4, a).otherwise(both)


def below(a: Column, b: Column) -> Column:
    """Whether a is at most b."""
    return (a["level"] == 0) | (b["level"] == 4) | ((a["level"] <= b["level"]) & (F.size(F.array_except(a["labels"], b["labels"])) == 0))


def join_states(a: Column, b: Column) -> Column:
    """Two maps of variables to values, joined variable by variable."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(join(x, y)))
