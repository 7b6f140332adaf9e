"""Language-model scoring with Brown classes.

The model is a class bigram: P(word | word before) = P(class | class before) * P(word | class). Every word
that training met ``CLUSTER_COUNT`` times gets one of ``CLASSES`` classes by exchange; rarer words stand for those that
training never met and share one more class with them, and the end of a text is a class of its own.

Counts cover all training texts. Each pass of the exchange adds up, for every clustered word, how often each class
stands before and after it. The ``CLUSTERED`` most frequent words are counted in arrays where the texts lie; bigrams
with any other word are counted once as a table, which each pass joins with the classes of that time, so the number of
clustered words has no bound. A word then goes to the class that raises the likelihood of all class bigrams most, the
others staying; half of the words are reconsidered in each pass, so neighbours do not swap back and forth.

The ``LISTED`` most frequent words (of at most ``LISTED_BYTES`` bytes each, which bounds the broadcast) are
scored where their text lies. Bigrams of each text with another word meet the exact counts and classes of all words by a
join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.functions.expressions import doubles
from churnlake.llm.common import pick, slices
from churnlake.session import staged

LISTED, LISTED_BYTES = 1 << 17, 256
CLUSTERED, CLASSES, PASSES = 1 << 15, 24, 3
FLUSH_WORDS, STEPS = 300_000, 1024
BLOCK_TOKENS = 2_000_000
CLUSTER_COUNT = 3
BACK_OFF = 5.0


@dataclass(frozen=True)
class Vocabulary:
    """Exact counts of training tokens; the ends of texts are tokens too."""

    counts: DataFrame  # word string, n long: every training word
    listed: list[bytes]  # the most frequent words, most frequent first
    listed_counts: list[int]
    tokens: int
    distinct: int
    ends: int


@dataclass(frozen=True)
class ClassModel:
    vocabulary: Vocabulary
    classes: np.ndarray  # class of each word counted in arrays, then of the rest, then of the end
    transitions: np.ndarray  # log10 P(class | class before)
    emissions: np.ndarray  # log10 P(word | class) of the words counted in arrays
    rest: float  # log10 of what divides (count + 0.5) for a word of the rest class
    words: DataFrame  # word, n, class (null: the rest) of every training word that is not counted in arrays
    weight: np.ndarray  # tokens of each class


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space."""
    return (text or b"").lower().split()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.select(rows.doc_id.cast("long").alias("doc_id"), rows.text.cast("binary").alias("text"))


def count_words(texts: DataFrame) -> Vocabulary:
    """texts: one binary column. Tasks combine before the shuffle and hand on ``FLUSH_WORDS`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.binary()), pa.array(known.values(), pa.int64())], ["word", "n"])
            known.clear()
            return batch

        ends = 0
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                known.update(words_of(text))
                ends += 1
            if len(known) > FLUSH_WORDS:
                yield out()
        if known:
            yield out()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    counted = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = staged(counted.select(F.col("word").cast("string").alias("word"), "n"), "word-counts")
    total = counts.agg(F.sum("n"), F.count("word"), F.sum(F.when(F.col("word").isNull(), F.col("n")))).first()
    ends = total[2] or 0
    counts = counts.where("word IS NOT NULL")
    short = counts.where(F.octet_length("word") <= LISTED_BYTES)
    top = sorted((-r["n"], r["word"].encode()) for r in short.where(F.col("n") >= _least_count(short)).collect())
    return Vocabulary(counts, [w for _, w in top], [-n for n, _ in top], total[0] or 0, total[1] + (ends > 0), ends)


def _least_count(counts: DataFrame) -> int:
    """The least count of which at most ``LISTED`` words have as many or more: counts of words by size of
    count narrow it down, ``STEPS`` rows a time, so no task and no sort holds the listed words."""
    low, high, above = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1, 0
    while low < high:
        step = max(1, (high - low) // STEPS)
        cell = F.expr(f"(n - {low}L) div {step}L")
        cells = counts.where(f"n >= {low}L AND n < {high}L").groupBy(cell.alias("c")).count().collect()
        for row in sorted(cells, key=lambda r: -r["c"]):
            if above + row["count"] > LISTED:
                low, high = low + row["c"] * step, min(high, low + (row["c"] + 1) * step)
                break
            above += row["count"]
        else:
            return low
        if high - low <= 1:
            return high
    return low


def _sequences(batches: Iterator[pa.RecordBatch], listed: list[bytes], column: int = 0) -> Iterator[np.ndarray]:
    """Blocks of word numbers, each text followed by -1; a word that is not listed has the number len(listed)."""
    number = {word: i for i, word in enumerate(listed)}
    held, size = [np.array([-1], np.int32)], 0
    for batch in slices(batches):
        for text in batch.column(column).to_pylist():
            words = words_of(text)
            held.append(np.fromiter(map(number.get, words, repeat(len(listed))), np.int32, len(words)))
            held.append(np.array([-1], np.int32))
            size += len(words) + 1
        if size > BLOCK_TOKENS:
            yield np.concatenate(held)
            held, size = [np.array([-1], np.int32)], 0
    if len(held) > 1:
        yield np.concatenate(held)


def _outer_bigrams(texts: DataFrame, shared, units: int) -> DataFrame:
    """left, left_word, right, right_word, n: all bigrams with a word that has no number; ``left`` and ``right`` are numbers
    where a side has one (the last is the end), else null."""
    names = ["left", "left_word", "right", "right_word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {word: i for i, word in enumerate(shared.value[0])}
        known: Counter = Counter()

        def out() -> pa.RecordBatch:
            sides = list(zip(*known))
            columns = []
            for side in sides:
                columns.append(pa.array([x if isinstance(x, int) else None for x in side], pa.int32()))
                columns.append(pa.array([None if isinstance(x, int) else x for x in side], pa.binary()))
            batch = pa.RecordBatch.from_arrays([*columns, pa.array(known.values(), pa.int64())], names)
            known.clear()
            return batch

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                unit = np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))
                open_ = np.flatnonzero(unit < 0)
                if len(open_):
                    tokens = [units - 1, *words, units - 1]
                    beside = np.concatenate((open_ - 1, open_ + 1))
                    beside = beside[(beside >= 0) & (beside < len(unit))]
                    for i in beside[unit[beside] >= 0].tolist():
                        tokens[i + 1] = int(unit[i])
                    known.update((tokens[i], tokens[i + 1]) for i in np.unique(np.concatenate((open_, open_ + 1))).tolist())
            if len(known) > FLUSH_WORDS:
                yield out()
        if known:
            yield out()

    made = texts.mapInArrow(run, "left int, left_word binary, right int, right_word binary, n long")
    summed = made.groupBy(*names[:4]).agg(F.sum("n").alias("n"))
    return summed.withColumns({c: F.col(c).cast("string") for c in ("left_word", "right_word")})


def _context_names(classes: int) -> list[str]:
    return [f"before_{c}" for c in range(classes)] + [f"after_{c}" for c in range(classes)]


def _neighbour_classes(texts: DataFrame, shared, units: int, classes: int) -> DataFrame:
    """unit, before_0.., after_0..: how often each class stands before and after each unit, over all bigrams of units that
    have numbers."""
    names = _context_names(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, of_unit = shared.value
        counts = np.zeros((2, units * classes), np.int64)
        for sequence in _sequences(batches, listed):
            unit = np.where(sequence < 0, units - 1, np.minimum(sequence, units - 2))
            pair = (unit[1:] != units - 2) & (unit[:-1] != units - 2)
            left, right = unit[:-1][pair], unit[1:][pair]
            counts[0] += np.bincount(right * classes + of_unit[left], minlength=units * classes)
            counts[1] += np.bincount(left * classes + of_unit[right], minlength=units * classes)
        table = np.concatenate(counts.reshape(2, units, classes), axis=1)
        met = np.flatnonzero(table.any(axis=1))
        for start in range(0, len(met), 8192):
            part = met[start : start + 8192]
            columns = [pa.array(part, pa.int32()), *[pa.array(c, pa.int64()) for c in table[part].T]]
            yield pa.RecordBatch.from_arrays(columns, ["unit", *names])

    return texts.mapInArrow(run, "unit int, " + ", ".join(f"{n} long" for n in names))


def _contexts(texts: DataFrame, outer: DataFrame, tail: DataFrame, shared, units: int, classes: int) -> DataFrame:
    """unit or word, own (its class), before_0.., after_0..: the neighbouring classes of everything that has a class. Words
    outside ``tail`` are the unit of the rest."""
    names, rest = _context_names(classes), units - 2

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_unit = shared.value[1]
        for batch in batches:
            unit = batch.column("unit").fill_null(-1).to_numpy()
            own = np.where(unit < 0, batch.column("own").fill_null(-1).to_numpy(), of_unit[unit])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.int32()), *batch.columns[3:]], batch.schema.names)

    def side(df: DataFrame, name: str) -> DataFrame:
        known = tail.select(F.col("word").alias(f"{name}_word"), F.col("class").alias(f"{name}_class"))
        df = df.join(known, f"{name}_word", "left")
        lost = F.col(f"{name}_word").isNotNull() & F.col(f"{name}_class").isNull()
        return df.withColumns({name: F.when(lost, rest).otherwise(F.col(name)), f"{name}_word": F.when(~lost, F.col(f"{name}_word"))})

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_unit = shared.value[1]
        for batch in batches:
            kinds = []
            for unit, kind in (("left", "left_class"), ("right", "right_class")):
                number = batch.column(unit).fill_null(-1).to_numpy()
                kinds.append(pa.array(np.where(number < 0, batch.column(kind).fill_null(-1).to_numpy(), of_unit[number]), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *kinds, batch.column("n")], batch.schema.names)

    columns = ["left", "left_word", "right", "right_word", "left_class", "right_class", "n"]
    met = side(side(outer, "left"), "right").select(*[F.col(c).cast("int") if c in ("left", "right", "left_class", "right_class") else F.col(c) for c in columns])
    met = met.mapInArrow(filled, "left int, left_word string, right int, right_word string, left_class int, right_class int, n long")
    sides = met.selectExpr(
        "inline(array(struct(right AS unit, right_word AS word, right_class AS own, left_class AS kind, n), "
        f"struct(left AS unit, left_word AS word, left_class AS own, right_class + {classes} AS kind, n)))"
    )
    sides = sides.groupBy("unit", "word", "own").agg(
        *[F.sum(F.when(F.col("kind") == i, F.col("n")).otherwise(0)).cast("long").alias(c) for i, c in enumerate(names)]
    )
    schema = "unit int, word string, own int, " + ", ".join(f"{n} long" for n in names)
    near = _neighbour_classes(texts, shared, units, classes).groupBy("unit").agg(*[F.sum(n).alias(n) for n in names])
    near = near.selectExpr("unit", "CAST(NULL AS string) AS word", "CAST(NULL AS int) AS own", *names).mapInArrow(numbered, schema)
    return near.unionByName(sides).groupBy("unit", "word", "own").agg(*[F.sum(n).alias(n) for n in names])


def _class_table(contexts: DataFrame, classes: int) -> np.ndarray:
    """How often each class follows each class, from the contexts of all units and words: one row for each class."""
    table = np.zeros((classes, classes))
    for row in contexts.groupBy("own").agg(*[F.sum(f"after_{c}") for c in range(classes)]).collect():
        table[row[0]] = row[1:]
    return table


def best_classes(before: np.ndarray, after: np.ndarray, now: np.ndarray, table: np.ndarray, movable: int) -> np.ndarray:
    """The class of each word that raises the likelihood most while all other words stay.

    before, after: each word's counts of neighbouring classes; table: class bigrams; only the first
    ``movable`` classes take words. A word's own counts are first taken out of the row and the column of
    its present class; all else is common to all words, so the gains are products of whole matrices.
    """
    word, full = np.arange(len(now)), np.maximum(table, 0) + 0.5
    logs = np.log(full)
    column, row = table[:, now].T - before, table[now] - after
    column[word, now] -= after[word, now]
    row[word, now] -= before[word, now]
    column, row = np.maximum(column, 0) + 0.5, np.maximum(row, 0) + 0.5
    out = after @ logs.T + after[word, now][:, None] * (np.log(column) - logs[:, now].T)
    out[word, now] = (after * np.log(row)).sum(1)
    come = before @ logs + before[word, now][:, None] * (np.log(row) - logs[now])
    come[word, now] = (before * np.log(column)).sum(1)
    left, right = full.sum(1) + column - full[:, now].T, full.sum(0) + row - full[now]
    left[word, now], right[word, now] = row.sum(1), column.sum(1)
    gain = out + come - after.sum(1)[:, None] * np.log(left) - before.sum(1)[:, None] * np.log(right)
    return np.argmax(gain[:, :movable], axis=1)


def _exchange(contexts: DataFrame, table: np.ndarray, classes: int, units: int, half: int) -> DataFrame:
    """unit or word, class: the new classes of one half of the words."""
    movable = classes - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("own").to_numpy()
            counts = np.stack([batch.column(3 + c).to_numpy() for c in range(2 * classes)], 1).astype(float)
            best = best_classes(counts[:, :classes], counts[:, classes:], own, table, movable)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(best, pa.int32())], ["unit", "word", "class"])

    turn = F.coalesce(F.col("unit"), F.xxhash64("word"))
    mine = contexts.where(F.col("unit").isNull() | (F.col("unit") < units - 2)).where(F.pmod(turn, F.lit(2)) == half)
    return mine.mapInArrow(run, "unit int, word string, class int")


def fit_class_model(
    docs: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    classes: int = CLASSES,
    passes: int = PASSES,
) -> ClassModel:
    """train: which rows teach, a condition over the column ``doc_id``; by default all.

    Null and empty texts are the end token alone; repeated rows count each. Without training rows every
    class is equally likely.
    """
    context = docs.sparkSession.sparkContext
    rows = _rows(docs, id_col, text_col)
    texts = (rows if train is None else rows.where(train)).select("text")
    vocabulary = count_words(texts)
    clustered = min(CLUSTERED, sum(n >= CLUSTER_COUNT for n in vocabulary.listed_counts))
    units, kinds = clustered + 2, classes + 2  # and the rest of the words, and the end
    of_unit = np.arange(units) % classes
    of_unit[-2:] = classes, classes + 1
    head = vocabulary.listed[:clustered]
    others = _without(vocabulary.counts, head, vocabulary.listed_counts[:clustered])
    start = F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(classes)).cast("int").alias("class")
    tail = staged(others.where(F.col("n") >= CLUSTER_COUNT).select("word", "n", start), "tail")
    table = np.zeros((kinds, kinds))
    if vocabulary.tokens:
        outer = staged(_outer_bigrams(texts, context.broadcast((head, of_unit)), units), "outer-bigrams")
    for number in range(passes + 1 if vocabulary.tokens else 0):
        shared = context.broadcast((head, of_unit))
        contexts = staged(_contexts(texts, outer, tail, shared, units, kinds), "contexts")
        table = _class_table(contexts, kinds)
        if number < passes:
            moved = staged(_exchange(contexts, table, kinds, units, number % 2), "moved")
            of_unit = of_unit.copy()
            for r in moved.where("unit IS NOT NULL").collect():  # at most ``CLUSTERED`` rows
                of_unit[r["unit"]] = r["class"]
            new = moved.where("word IS NOT NULL").select("word", F.col("class").alias("new"))
            tail = staged(tail.join(new, "word", "left").select("word", "n", F.coalesce("new", "class").alias("class")), "tail")
    weight = np.zeros(kinds)
    np.add.at(weight, of_unit[:clustered], vocabulary.listed_counts[:clustered])
    n_tail = 0
    for r in tail.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        weight[r["class"]] += r["n"]
        n_tail += r["k"]
    weight[-1] = vocabulary.ends
    weight[-2] = vocabulary.tokens - weight.sum()
    prior = (weight + 0.5) / (weight + 0.5).sum()
    transitions = np.log10((table + BACK_OFF * prior) / (table.sum(1, keepdims=True) + BACK_OFF))
    counts = np.array(vocabulary.listed_counts[:clustered], float)
    emissions = np.log10(counts / weight[of_unit[:clustered]]) if clustered else counts
    rest_words = vocabulary.distinct - clustered - n_tail - (vocabulary.ends > 0)
    words = staged(others.join(tail.select("word", "class"), "word", "left").select("word", "n", "class"), "words")
    rest = math.log10(weight[-2] + 0.5 * (rest_words + 1))
    return ClassModel(vocabulary, of_unit, transitions, emissions, rest, words, weight)


def _without(counts: DataFrame, head: list[bytes], head_counts: list[int]) -> DataFrame:
    """The words that are not among the first of the list, which is ordered by falling count and then by bytes."""
    if not head:
        return counts
    last, n = F.lit(head[-1].decode()), F.col("n")
    return counts.where((F.octet_length("word") > LISTED_BYTES) | (n < head_counts[-1]) | ((n == head_counts[-1]) & (F.col("word") > last)))


def score_texts(docs: DataFrame, model: ClassModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    n_tokens: words and the end; n_known: those that training met; base_score: log10 probability by word
    counts with 0.5 added to each; score: by the class model; perplexity: 10 ** (-score / n_tokens).

    A null or empty text is the end alone. Repeated rows and null ids are scored each; an empty table gives
    no rows. Other columns are ignored.
    """
    known, kinds = model.vocabulary, len(model.transitions)
    divisor = math.log10(known.tokens + 0.5 * (known.distinct + 1))
    size, head = len(known.listed), len(model.emissions)
    counts = np.array(known.listed_counts, float)
    kind = np.full(size + 2, model.classes[-2])
    kind[:head], kind[-1] = model.classes[:-2], model.classes[-1]
    place = {word: i for i, word in enumerate(known.listed)}
    least = known.listed_counts[-1] if size else 0
    numbered = model.words.where(F.col("class").isNotNull() & (F.col("n") >= least) & (F.octet_length("word") <= LISTED_BYTES))
    for r in numbered.select("word", "class").collect():  # listed words, at most ``LISTED``
        kind[place[r["word"].encode()]] = r["class"]
    plain = np.append(np.log10(counts + 0.5), [0.0, math.log10(known.ends + 0.5)])  # by word, unlisted, end
    alone = kind[:size] == model.classes[-2]
    given = np.where(alone, plain[:size] - model.rest, np.log10(np.maximum(counts, 1) / np.maximum(model.weight[kind[:size]], 1)))
    given = np.append(given, [0.0, 0.0])
    shared = docs.sparkSession.sparkContext.broadcast((known.listed, known.ends, kind, plain, given, model.transitions))
    side = pa.struct([("left", pa.int32()), ("left_word", pa.binary()), ("right", pa.int32()), ("right_word", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, ends, kind, plain, given, transitions = shared.value
        size = len(listed)
        number = {word: i for i, word in enumerate(listed)}
        for batch in slices(batches):
            tokens, met, base, score, outer = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                sequence = np.fromiter(map(number.get, words, repeat(size)), np.int64, len(words))
                unlisted = np.flatnonzero(sequence == size)
                sequence = np.append(sequence, size + 1)
                path = np.concatenate(([kind[-1]], kind[sequence]))
                steps = transitions[path[:-1], path[1:]]
                found = []
                if len(unlisted):  # bigrams with an unlisted word are scored where its class is known
                    open_, open_steps = set(unlisted.tolist()), np.unique(np.concatenate((unlisted, unlisted + 1)))
                    steps[open_steps] = 0.0
                    for i in open_steps.tolist():
                        left, right = i - 1 in open_, i in open_
                        found.append((None if left else int(path[i]), words[i - 1] if left else None,
                                      None if right else int(path[i + 1]), words[i] if right else None))
                tokens.append(len(sequence))
                met.append(len(words) - len(unlisted) + (ends > 0))
                base.append(plain[sequence].sum() - divisor * len(sequence))
                score.append(given[sequence].sum() + steps.sum())
                outer.append([dict(zip(("left", "left_word", "right", "right_word"), x)) for x in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(tokens, pa.int64()),
                    pa.array(met, pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(score, pa.float64()),
                    pa.array(outer, pa.list_(side)),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score", "outer"],
            )

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, "
    schema += "outer array<struct<left: int, left_word: binary, right: int, right_word: binary>>"
    scored = _rows(docs, id_col, text_col).mapInArrow(run, schema)
    scored = staged(scored.select(F.monotonically_increasing_id().alias("row"), "*"), "scored")
    steps = scored.where(F.size("outer") > 0).select("row", F.inline("outer"))
    for name in ("left", "right"):
        told = model.words.select(F.col("word").alias(f"{name}_word"), F.col("n").alias(f"{name}_n"), F.col("class").alias(f"{name}_class"))
        steps = steps.withColumn(f"{name}_word", F.col(f"{name}_word").cast("string")).join(told, f"{name}_word", "left")
    rest_class = F.lit(int(model.classes[-2]))
    left, right = (F.coalesce(n, f"{n}_class", rest_class) for n in ("left", "right"))
    step = doubles(model.transitions.ravel().tolist())[left * kinds + right]
    count, unlisted = F.coalesce("right_n", F.lit(0)), F.col("right_word").isNotNull()
    in_class = F.log10(F.col("right_n") / doubles(np.maximum(model.weight, 1).tolist())[F.coalesce("right_class", rest_class)])
    emission = F.when(F.col("right_class").isNotNull(), in_class).otherwise(F.log10(count + 0.5) - F.lit(model.rest))
    tail = steps.groupBy("row").agg(
        F.sum(step + F.when(unlisted, emission).otherwise(0.0)).alias("steps"),
        F.sum(F.when(unlisted, F.log10(count + 0.5))).alias("more"),
        F.count("right_n").alias("met"),
    )
    more, met = F.coalesce("more", F.lit(0.0)), F.coalesce("met", F.lit(0))
    score = F.col("score") + F.coalesce("steps", F.lit(0.0))
    return scored.join(tail, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + met).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
