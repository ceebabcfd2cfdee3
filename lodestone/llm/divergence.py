"""How differently the sources of a language use its terms: exact sums over an inverted index of corrections.

A language keeps the terms of enough of its documents.  Every source gives a
kept term the share p = 1 + floor(10^9 (count + 5) / (N + 5 V)), and two
sources differ by the sum of |p - q| over all V terms.  Most counts are zero,
so a pair starts at V times its difference at zero counts, and the postings of
the terms, which hold only counts above zero, add what is not zero:

* for terms that one source has, against the other's share at zero: these
  depend on the first source's shares and one threshold, so sorted shares with
  running counts and sums answer all thresholds at once;
* for terms that both have, the rest: postings lists are dealt over blocks of
  sources, tasks add up their corrections per pair of sources.

Tasks count terms before anything is shuffled; a posting's list in a task is
never longer than two blocks, however many sources a language has.  What grows
with the square of the sources is the result itself.

Defined cases: a null text, lang or source is the empty one; a document counts
once for a term however often it holds it; repeated rows are documents of
their own; a group without kept terms has N = 0 and still all pairs; without
any kept term a pair's value is 0; sums are whole numbers, exact at any size;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_or_empty, texts_of, tidy, written

LEAST_DOCUMENTS = 30
TOP_TERMS = 50
SHARE, PRIOR = 1_000_000_000, 5
#: Sources of a block: a task's sums of a pair of blocks are their square in 8-byte numbers.
BLOCK = 256
#: Entries a task holds before it passes them on.
HELD_TERMS, HELD_BLOCKS = 400_000, 64
#: Bytes of a very long text that are cut into terms at a time.
PIECE = 1 << 22
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_GAP = re.compile(rb"[^a-z\x80-\xff]")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.int64())])


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """A lower-cased text in pieces that end between terms (a term may be longer than a piece)."""
    at = 0
    while len(text) - at > size:
        gap = _GAP.search(text, at + size)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per (lang, source, term): of occurrences and of documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
            yield from pa.Table.from_arrays(columns, schema=_COUNTS).to_batches(max_chunksize=20_000)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), texts_of(batch["text"]), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            own: set[bytes] = set()
            for piece in pieces(text.lower()):
                terms = _TERM.findall(piece)
                n.update(terms)
                own.update(terms)
            docs.update(own)
        if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
            yield from passed_on()
    yield from passed_on()


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (N + 5 V)); null for V = 0."""
    top = (count.cast("decimal(19,0)") + PRIOR) * F.lit(SHARE)
    bottom = total.cast("decimal(19,0)") + terms.cast("decimal(19,0)") * PRIOR
    return F.when(terms > 0, F.call_function("div", top, bottom).cast("long") + 1)


def postings(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Kept terms by source (lang, source, term, count, p, q), and groups (lang, source, place, n_terms, zero).

    p is the source's share, q the language's; zero the source's share of a
    term that it does not have, place its number among the language's sources.
    """
    named = docs.select(text_or_empty("lang").alias("lang"), text_or_empty("source").alias("source"), text_or_empty("text").alias("text"))
    counted = named.mapInArrow(tidy(_count), "lang string, source string, term string, n long, docs long")
    sums = written(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    kept = sums.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("d")).filter(F.col("d") >= least_documents).drop("d")
    kept = written(kept, "terms-kept")
    held = written(sums.drop("docs").join(kept, ["lang", "term"]), "terms-postings")
    discard(sums)

    per_lang = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    per_source = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = named.select("lang", "source").distinct().join(per_source, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("n_terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = written(groups.withColumns({"place": place, "zero": _share(F.lit(0), F.col("total"), F.col("n_terms"))}), "terms-groups")
    shares = held.join(groups, ["lang", "source"]).select(
        "lang", "source", "place", "term", "zero", F.col("n").alias("count"),
        _share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).alias("q"),
    )
    return written(shares, "terms-shares"), groups.select("lang", "source", "place", "n_terms", "zero")


def _common(block: int):
    """Corrections of the terms that two sources both have, per pair, of rows (lang, x, y, list of a term's sources in blocks x and y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], np.ndarray] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, x, y), sums in held.items():
                a, b = np.nonzero(sums)
                columns = [pa.array([lang] * len(a), pa.string()), pa.array(a + x * block), pa.array(b + y * block), pa.array(sums[a, b])]
                yield pa.RecordBatch.from_arrays(columns, schema=_SUMS)
            held.clear()

        for batch in batches:
            lists = batch["list"]
            ends, flat = lists.offsets.to_numpy(), lists.values
            place, p, zero = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for i, (lang, x, y) in enumerate(zip(batch["lang"].to_pylist(), batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)):
                s = slice(ends[i], ends[i + 1])
                at, share, none = place[s], p[s], zero[s]
                first, second = (at // block == x).nonzero()[0], (at // block == y).nonzero()[0]
                if not len(first) or not len(second):
                    continue
                if (lang, x, y) not in held:
                    if len(held) == HELD_BLOCKS:
                        yield from passed_on()
                    held[lang, x, y] = np.zeros((block, block), np.int64)
                pa_, za, pb, zb = share[first, None], none[first, None], share[None, second], none[None, second]
                more = abs(pa_ - pb) - abs(pa_ - zb) - abs(za - pb) + abs(za - zb)
                if x == y:
                    more[at[first, None] >= at[None, second]] = 0
                held[lang, x, y][np.ix_(at[first] - x * block, at[second] - y * block)] += more
        yield from passed_on()

    return tidy(run)


def _both(shares: DataFrame, groups: DataFrame, block: int) -> DataFrame:
    """(lang, a, b, x): corrections of the terms that sources a and b both have, a before b."""
    blocks = groups.groupBy("lang").agg((F.max("place") / block).cast("long").alias("last"))
    own = (F.col("place") / block).cast("long")
    entry = F.struct("place", "p", "zero").alias("entry")
    rows = shares.join(F.broadcast(blocks) if blocks.count() <= 10_000 else blocks, "lang").select("lang", "term", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"), entry)
    lists = rows.groupBy("lang", "term", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.collect_list("entry").alias("list"))
    sums = lists.filter(F.size("list") > 1).select("lang", "x", "y", "list").mapInArrow(_common(block), "lang string, a long, b long, x long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("x").alias("x"))


def _one_sided(shares: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, one): corrections of the terms that source a has, as if b had none of them, for all pairs (lang, a, b, zero_a, zero_b)."""
    alike = shares.groupBy("lang", F.col("place").alias("a"), "p").agg(F.count(F.lit(1)).alias("m"))
    marks = pairs.select("lang", "a", F.col("zero_b").alias("p"), F.lit(0).cast("long").alias("m"), F.lit(True).alias("asks"), "b", "zero_a")
    both = alike.select("lang", "a", "p", "m", F.lit(False).alias("asks"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("zero_a")).unionByName(marks)
    below = Window.partitionBy("lang", "a").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal shares add 0
    of_all = Window.partitionBy("lang", "a").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m, mp = F.col("m"), F.col("m") * F.col("p")
    found = both.withColumns({"lm": F.sum(m).over(below), "ls": F.sum(mp).over(below), "am": F.sum(m).over(of_all), "as": F.sum(mp).over(of_all)}).filter("asks")
    difference = F.col("as") - 2 * F.col("ls") + (2 * F.col("lm") - F.col("am")) * F.col("p")
    return found.select("lang", "a", "b", (difference - F.col("am") * F.abs(F.col("zero_a") - F.col("p"))).alias("one"))


def source_pairs(shares: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value): every pair of different sources of a language, both ways."""
    a = groups.select("lang", "n_terms", F.col("place").alias("a"), F.col("source").alias("source_a"), F.col("zero").alias("zero_a"))
    b = groups.select("lang", F.col("place").alias("b"), F.col("source").alias("source_b"), F.col("zero").alias("zero_b"))
    pairs = written(a.join(b, "lang").filter("a <> b"), "terms-pairs")  # as many as the result has
    one = written(_one_sided(shares, pairs.filter("n_terms > 0")), "terms-one-sided")
    both = written(_both(shares, groups, block), "terms-both")
    back = one.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("one").alias("other"))
    half = pairs.filter("a < b").join(one, ["lang", "a", "b"], "left").join(back, ["lang", "a", "b"], "left").join(both, ["lang", "a", "b"], "left")
    base = F.col("n_terms") * F.abs(F.col("zero_a") - F.col("zero_b"))
    value = F.coalesce(base + F.coalesce("one", F.lit(0)) + F.coalesce("other", F.lit(0)) + F.coalesce("x", F.lit(0)), F.lit(0)).alias("value")
    there, again = F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))
    return half.select("lang", F.explode(F.array(there, again)).alias("s"), value).select("lang", "s.source", "s.item", "value")


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair, all other sources of the language by their difference; part term, the terms that stand out most."""
    shares, groups = postings(docs, least_documents)
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = source_pairs(shares, groups, block).withColumn("rank", F.row_number().over(by_value))
    terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top_terms)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
