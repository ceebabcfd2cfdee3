"""Language-model scores of whole documents by a class-factored recurrent network.

Three things are learned from the training rows, all distributed:

* counts of every distinct word, combined in each task before they shuffle;
* the network (see ``gru``) over the ``vocabulary`` most frequent words, an
  end and one item for all rarer words; a rarer word has that item's
  probability times its own add-one share of the rarer words' counts, and an
  unknown word the share of a count of zero, as in the base score;
* in ``rounds`` rounds every task trains from the same parameters on its own
  documents, and parameters are averaged by words trained on.  Each round takes
  one of ``parts`` of the documents, whole, so that every training word is
  trained on, after its true predecessors.  Training grows with the corpus.

The counts that reach every task are those of at most ``known_words`` words (a
bound of about 40 MB); words beyond it meet their counts in an equality join
of (document, word, times) rows.  Averages are added up in groups of 32, so
that the driver never holds more than 32 parameter sets.

Defined cases: null and empty texts are one end token; a null id is neither
trained on nor held out; repeated rows are scored each; an empty training set
counts nothing, and every known-nothing token has base probability 1; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import discard, keep_freed, quoted, remainder, small_batches, text_or_empty, tidy, written

VOCABULARY = 4094
KNOWN_WORDS = 262_144
HIDDEN = 16
CLASSES = 48
ROUNDS = 2
#: Documents are dealt into so many parts, of which each round trains on one: every word once.
PARTS = 2
#: Words that a counting task holds before it counts them and passes the counts on.
HELD_WORDS = 3_000_000
#: Parameter sets that one task, or at last the driver, adds up.
AT_ONCE = 16
#: Tokens that go through the network side by side in one task.
SIDE_BY_SIDE = 3_000_000


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each text has, and the words of all, A-Z lower-cased: bytes split at ASCII white space only."""
    bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    parts = pc.ascii_split_whitespace(bare)
    lengths, words = parts.value_lengths().to_numpy(), parts.flatten().cast(pa.binary())
    empty = pc.binary_length(bare).to_numpy() == 0  # one empty word each
    if empty.any():
        lengths, words = np.where(empty, 0, lengths), words.filter(pc.greater(pc.binary_length(words), 0))
    return lengths.astype(np.int64), words


def places_in(words: pa.Array, listed: pa.Array) -> np.ndarray:
    """Where words stand among the listed ones; their number for one that does not."""
    return pc.index_in(words, value_set=listed).fill_null(len(listed)).to_numpy()


def sequences_of(lengths: np.ndarray, items: np.ndarray, end: int) -> list[np.ndarray]:
    """The items of each text and the end."""
    ends = np.cumsum(lengths + 1)
    out, inside = np.full(len(items) + len(lengths), end, np.int32), np.ones(len(items) + len(lengths), bool)
    inside[ends - 1] = False
    out[inside] = items
    return np.split(out, ends[:-1])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the column t, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def out() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.binary()).value_counts()
            held.clear()
            return pa.RecordBatch.from_arrays([found.field(0), found.field(1)], ["word", "c"])

        for batch in batches:
            held.append(words_in(batch.column(0))[1])
            if sum(map(len, held)) > HELD_WORDS:
                yield out()
        yield out()

    return written(texts.mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "lm-counts")


def frequent(counts: DataFrame, most: int) -> tuple[pa.Array, np.ndarray]:
    """The most frequent words and their counts, at most so many, in order: all above a count, found from a histogram of 64 bins per power of two."""
    bin_of = F.floor(F.log2("c") * 64)
    bins = sorted(counts.groupBy(bin_of.alias("b")).count().collect(), reverse=True)  # at most 4,096 rows
    total, least = 0, None
    for row in bins:
        total += row["count"]
        if total > most:
            break
        least = row["b"]
    if least is None:
        return pa.array([], pa.binary()), np.empty(0, np.int64)
    found = counts.filter(bin_of >= least).toArrow().sort_by([("c", "descending"), ("word", "ascending")]).combine_chunks()
    return found.column(0).combine_chunks(), found.column(1).to_numpy()


def _averaged(trained: DataFrame, size: int) -> np.ndarray | None:
    """The mean of parameter rows (tokens, data), weighted by tokens, added up AT_ONCE at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total = 0, np.zeros(size)
        for batch in batches:
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                weight, total = weight + n, total + n * np.frombuffer(data, np.float32).astype(np.float64)
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight], pa.int64()), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["tokens", "data"])

    rows = written(trained, "lm-trained")
    count = rows.count()
    while count > AT_ONCE:
        count = -(-count // AT_ONCE)
        fewer = written(rows.repartition(count).mapInArrow(tidy(add), "tokens long, data binary"), "lm-trained")
        discard(rows)
        rows = fewer
    weight, total = 0, np.zeros(size)
    for row in rows.collect():  # AT_ONCE at most
        weight, total = weight + row["tokens"], total + row["tokens"] * np.frombuffer(row["data"], np.float32).astype(np.float64)
    discard(rows)
    return total / weight if weight else None


def _train(texts: DataFrame, items: dict[bytes, int], shape: gru.Shape, end: int, rare: int, parameters: gru.Parameters) -> gru.Parameters:
    """One round: every task trains on all words of its documents; the results' average."""
    given = texts.sparkSession.sparkContext.broadcast((items, shape, parameters))
    size = sum(v.size for v in parameters.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        items, shape, parameters = given.value
        listed, numbers = pa.array(list(items), pa.binary()), np.array([*items.values(), rare], np.int32)
        trainer = gru.Trainer(parameters, shape, end)
        held: list[np.ndarray] = []

        def learn() -> None:
            """The longest first: the last ones to end are then about as long as the others."""
            held.sort(key=len, reverse=True)
            for ids in held:
                trainer.add(ids)
            held.clear()

        size = 0
        for batch in batches:
            lengths, words = words_in(batch.column(0))
            if len(lengths):
                held.extend(sequences_of(lengths, numbers[places_in(words, listed)], end))
                size += len(words) + len(lengths)
            if size > SIDE_BY_SIDE:
                learn()
                size = 0
        learn()
        trainer.finish()
        if trainer.tokens:
            yield pa.RecordBatch.from_arrays([pa.array([trainer.tokens], pa.int64()), pa.array([gru.packed(trainer.p)], pa.binary())], ["tokens", "data"])

    mean = _averaged(texts.mapInArrow(tidy(run), "tokens long, data binary"), size)
    given.unpersist()
    return parameters if mean is None else gru.unpacked(mean, parameters)


def lm_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2,
    vocabulary: int = VOCABULARY, known_words: int = KNOWN_WORDS, hidden: int = HIDDEN, classes: int = CLASSES, rounds: int = ROUNDS, parts: int = PARTS,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    base_score: log10 probability by add-one word counts; score: by the model.
    """
    if parts > rounds:
        raise ValueError("parts must not be more than rounds: every training word is trained on")
    spark = docs.sparkSession
    small_batches(spark)
    rest = remainder(id_col, modulus)
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.coalesce(rest == held_out, F.lit(False)).alias("held"), text_or_empty(quoted(text_col)).alias("t"))
    training = docs.filter(rest != held_out).select(text_or_empty(quoted(text_col)).alias("t"))

    counts = word_counts(training)
    ends = training.count()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = total + ends, distinct + (ends > 0)
    words, top = frequent(counts, known_words)
    chosen = list(zip(words[:vocabulary].to_pylist(), top[:vocabulary].tolist(), strict=True))
    rare_n, rare_v = total - sum(c for _, c in chosen), distinct - len(chosen)

    # items: the end, the rarer words together, the chosen words; numbered by descending count
    named = sorted([(ends, b"", True), (rare_n, b" ", True), *((c, w, False) for w, c in chosen)], key=lambda x: (-x[0], x[1]))
    items = {w: i for i, (_, w, special) in enumerate(named) if not special}
    end, rare = (next(i for i, x in enumerate(named) if x[2] and x[1] == w) for w in (b"", b" "))
    shape = gru.Shape.of(np.array([c for c, _, _ in named], np.float64), classes, hidden, alone=rare)
    parameters = gru.initial(shape)
    if ends:
        for k in range(rounds):
            part = training.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == k % parts)
            parameters = _train(part, items, shape, end, rare, parameters)
    # training texts hold no unknown word; the rarer words' item gets the add-one mass of its words and of one unknown
    parameters["class_bias"][shape.class_of[rare]] += np.float32(math.log((rare_n + rare_v + 1) / (rare_n + 1)))

    log_counts = np.log10(np.append(top.astype(np.float64), 0) + 1)  # the last is for words beyond the known, whose counts come later
    to_item = np.full(len(top) + 1, rare, np.int32)
    to_item[: len(chosen)] = [items[w] for w, _ in chosen]
    given = spark.sparkContext.broadcast((words, log_counts, to_item, shape, parameters))
    end_log, end_known = math.log10(ends + 1), ends > 0
    kind = dict(docs.dtypes)[id_col]

    names = ["__id", "held", "n_tokens", "known", "logs", "n_rare", "rare_logs", "tail", "model"]
    entry = pa.struct([("word", pa.binary()), ("n", pa.int64())])

    def counted(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        """What the known words' counts give each row, and its items."""
        known, log_counts, to_item, _, _ = given.value
        lengths, words = words_in(batch.column(2))
        at = places_in(words, known)
        items, logs, owner = to_item[at], log_counts[at], np.repeat(np.arange(len(lengths)), lengths)
        per_row = lambda where, weights=None: np.bincount(owner[where], None if weights is None else weights[where], len(lengths))
        inside, rarer = at < len(known), items == rare
        beyond = np.flatnonzero(~inside)
        unknown = words.take(pa.array(beyond)).to_pylist()
        cuts = np.searchsorted(owner[beyond], np.arange(len(lengths) + 1)).tolist()
        tails = [Counter(unknown[i:j]) if i < j else {} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        entries = pa.StructArray.from_arrays([pa.array([w for t in tails for w in t], pa.binary()), pa.array([n for t in tails for n in t.values()], pa.int64())], fields=list(entry))
        tail = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tails)]), pa.int32()), entries)
        values = lengths + 1, per_row(inside) + int(end_known), per_row(slice(None), logs) + end_log, per_row(rarer), per_row(rarer, logs)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, values), tail], names[:-1]), sequences_of(lengths, items, end)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of several batches go through the network side by side, as a long one's last steps are alone in its batch."""
        keep_freed()
        _, _, _, shape, parameters = given.value
        held, sequences = [], []

        def out() -> Iterator[pa.RecordBatch]:
            scores, at = gru.score(parameters, shape, sequences, end) / math.log(10), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores[at : at + batch.num_rows])], names)
                at += batch.num_rows
            held.clear()
            sequences.clear()

        for batch in batches:
            if batch.num_rows:
                rows, items_of = counted(batch)
                held.append(rows)
                sequences.extend(items_of)
                if sum(map(len, sequences)) > SIDE_BY_SIDE:
                    yield from out()
        if held:
            yield from out()

    schema = f"__id {kind}, held boolean, n_tokens long, known long, logs double, n_rare long, rare_logs double, tail array<struct<word:binary,n:long>>, model double"
    scored = written(rows.mapInArrow(tidy(score), schema).withColumn("__row", F.monotonically_increasing_id()), "lm-scored")
    tail = scored.select("__row", F.explode("tail").alias("x")).select("__row", "x.word", "x.n").join(counts, "word")
    per_row = tail.groupBy("__row").agg(F.sum("n").alias("tail_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_logs"))
    joined = scored.drop("tail").join(per_row, "__row", "left").fillna({"tail_known": 0, "tail_logs": 0.0})
    base = F.col("logs") + F.col("tail_logs") - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    model = F.col("model") + F.col("rare_logs") + F.col("tail_logs") - F.col("n_rare") * F.lit(math.log10(rare_n + rare_v + 1))
    return joined.select(
        F.col("__id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("tail_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        model.alias("score"),
    )
