"""Very many patterns over texts: an automaton over what each pattern must contain says which of them can match at all.

From each pattern's parsed form comes a set of literal strings of which every
match holds at least one.  One Aho-Corasick automaton over the literals of all
patterns reads a text once and gives its candidates; only these are searched
with the full expression.  Patterns without such literals are always searched,
so no match is lost.  Case and the few letters that regular expressions take
for others without case are folded on both sides.
"""

from __future__ import annotations

import re
import re._constants as op
import re._parser as parser
from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shorter literals are in too many texts, and more of them than this in one pattern too.
LEAST_LITERAL, MOST_LITERALS = 3, 64
# Letters that match ASCII letters where case is ignored and whose lower case is not that letter alone.
_FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}


def folded(text: str) -> str:
    return (text if text.isascii() else text.translate(_FOLDED)).lower()


class _Sequence:
    """The literal sets that a sequence of parsed items must hold one of, as they are met."""

    def __init__(self) -> None:
        self.run, self.sets = "", []

    def flush(self) -> None:
        if self.run:
            self.sets.append(frozenset([self.run]))
        self.run = ""

    def letter(self, codes: Iterable[int]) -> None:
        letters = {folded(chr(c)) for c in codes}
        if len(letters) == 1 and (one := letters.pop()).isascii():
            self.run += one
        else:
            self.flush()

    def items(self, items: Iterable[tuple]) -> None:
        for kind, value in items:
            if kind is op.LITERAL:
                self.letter([value])
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                self.letter([v for _, v in value])
            elif kind is op.AT or kind is op.ASSERT_NOT:
                pass  # nothing of the text is taken
            elif kind is op.SUBPATTERN:
                self.items(value[3])
            elif kind is op.ATOMIC_GROUP:
                self.items(value)
            else:
                self.flush()
                if kind is op.BRANCH:
                    options = [best(x) for x in value[1]]
                    if all(options):
                        self.sets.append(frozenset().union(*options))
                elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
                    self.sets.append(best(value[2]))
                elif kind is op.ASSERT:
                    self.sets.append(best(value[1]))


def best(items: Iterable[tuple]) -> frozenset[str]:
    """The most telling set of literals that any match of the items holds one of; empty if there is none."""
    sequence = _Sequence()
    sequence.items(items)
    sequence.flush()
    fit = [s for s in sequence.sets if s and len(s) <= MOST_LITERALS]
    return max(fit, key=lambda s: (min(map(len, s)), -len(s)), default=frozenset())


def required(pattern: str, flags: int = 0) -> frozenset[str]:
    """Folded literals of which any match of the pattern holds at least one; empty if none can be told or the pattern cannot be read."""
    try:
        found = best(parser.parse(pattern, flags))
    except (re.error, RecursionError, OverflowError):
        return frozenset()
    return found if found and min(map(len, found)) >= LEAST_LITERAL else frozenset()


class Candidates:
    """Which of many keyed patterns can match a text."""

    def __init__(self, patterns: dict[Hashable, tuple[str, int]]) -> None:
        of: dict[str, list[Hashable]] = {}
        self.always: set[Hashable] = set()
        for key, (pattern, flags) in patterns.items():
            literals = required(pattern, flags)
            for x in literals:
                of.setdefault(x, []).append(key)
            if not literals:
                self.always.add(key)
        self.keys = list(of.values())
        self.automaton = ahocorasick.Automaton()
        for k, x in enumerate(of):
            self.automaton.add_word(x, k)
        if of:
            self.automaton.make_automaton()

    def of(self, text: str) -> set[Hashable]:
        out = set(self.always)
        if self.keys:
            for k in {k for _, k in self.automaton.iter(folded(text))}:
                out.update(self.keys[k])
        return out


@dataclass(frozen=True)
class Pattern:
    """A regular expression of Python's dialect, by number."""

    number: int
    expression: str
    flags: int = re.M


def matched(texts: DataFrame, patterns: list[Pattern], id_col: str = "doc_id", text_col: str = "text", filtered: bool = True) -> DataFrame:
    """(id, pattern, match_no, line, matched) of all matches of all patterns in whole texts.

    The patterns are a parameter.  Null texts are empty; matches of a pattern
    are numbered from 1; an expression that cannot be compiled raises.
    filtered=False searches every text for every pattern: the same rows.
    """
    compiled = {p.number: re.compile(p.expression, p.flags) for p in patterns}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        candidates = Candidates({p.number: (p.expression, p.flags) for p in patterns}) if filtered else None
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"], strict=True):
                for number in sorted(candidates.of(text) if candidates else compiled):
                    line, counted = 1, 0
                    for n, m in enumerate(compiled[number].finditer(text), 1):
                        line, counted = line + text.count("\n", counted, m.start()), m.start()
                        rows.append((key, number, n, line, m[0]))
            yield pd.DataFrame(rows, columns=["id", "pattern", "match_no", "line", "matched"])

    kind = dict(texts.dtypes)[id_col]
    given = texts.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return given.mapInPandas(run, f"id {kind}, pattern int, match_no int, line int, matched string")

