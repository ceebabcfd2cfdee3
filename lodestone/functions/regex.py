"""Regular expressions over whole texts, as built-in column expressions.

Patterns are written in Python's dialect.  ``java`` adds the flags with which
Java reads them alike; lines end at a line feed only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "array<struct<line:int,column:int,matched:string,before:string,after:string>>"


def java(pattern: str, ignore_case: bool = False, multiline: bool = False, dotall: bool = False) -> str:
    """The pattern for Java: line feed as the only line end, Unicode classes, and Python's flags."""
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: "(?<" + m[1].replace("_", "") + ">", pattern)
    return "(?dU" + "i" * ignore_case + "m" * multiline + "s" * dotall + ")" + pattern


def glob(pattern: str) -> str:
    """A shell glob as an anchored Java pattern; ``*`` also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            inside = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return "(?s)^" + out + "$"


#: A private-use character that marks where matches begin.
_MARK = "\uf8f0"


def matches(content: Column, pattern: str, around: int = 0) -> Column:
    """All matches of a Java pattern with their line (from 1), and ``around`` characters before and after each.

    Matches are marked in the text, and each line of the marked text says how
    many begin in it, so the work grows with the text and not with the square
    of its matches.  Texts without a match cost one search.  With ``around``,
    for the few checks that judge a match's surroundings, it grows with
    matches times text.
    """
    lit = F.lit(pattern)
    found = F.regexp_extract_all(content, lit, F.lit(0))
    clean = F.translate(content, _MARK, " ")
    marked = F.regexp_replace(clean, pattern, _MARK + "$0")
    at_line = lambda line, i: F.array_repeat(i + 1, F.length(line) - F.length(F.translate(line, _MARK, "")))
    at = F.flatten(F.transform(F.split(marked, "\n", -1), at_line))
    if not around:
        one = lambda m, line: F.struct(line.cast("int").alias("line"), F.lit(0).alias("column"), m.alias("matched"), F.lit("").alias("before"), F.lit("").alias("after"))
        return F.when(content.rlike(pattern), F.zip_with(found, at, one)).otherwise(F.array().cast(MATCH))
    pieces = F.split(marked, _MARK, -1)

    def one_of(i: Column) -> Column:
        head, match = F.array_join(F.slice(pieces, 1, i), ""), F.element_at(found, i)
        return F.struct(
            F.element_at(at, i).cast("int").alias("line"),
            F.length(F.element_at(F.split(F.element_at(pieces, i), "\n", -1), -1)).cast("int").alias("column"),
            match.alias("matched"),
            F.right(head, F.lit(around)).alias("before"),
            F.substring(content, F.length(head) + F.length(match) + 1, around).alias("after"),
        )

    return F.when(content.rlike(pattern), F.transform(F.sequence(F.lit(1), F.size(found)), one_of)).otherwise(F.array().cast(MATCH))


def nth_line(content: Column, line: Column) -> Column:
    """The text of a line, from 1; null past the end."""
    return F.try_element_at(F.split(content, "\n", -1), line)


def any_of(column: Column, patterns: list[str]) -> Column:
    """Whether any of the Python patterns is found, whatever the case."""
    return column.rlike(java("(?:" + ")|(?:".join(patterns) + ")", ignore_case=True))
