"""Toxic passages by maximum-scoring segments.

Token scores are log-odds between toxic and other labelled documents with a Dirichlet prior (in how many
documents a token occurs, so one document that repeats a line counts once). Tokens are words; a word that
the fit has not met scores as its longest known beginning. Tokens whose log-odds, of either sign, stand out by
``Z_MIN`` standard errors score them: those of toxic texts gain, those of other texts cost. Any other token costs
``DRIFT``. Every occurrence of a token scores. A token needs evidence in sampled documents to stand out, so the number of
scores is bounded by the sample, and none is left out.

A linear scan (after Ruzzo and Tompa) yields all maximal-scoring segments of a text. Their scores are
calibrated as extreme values: for a text of n tokens from other documents the best score S follows
P(S > s) = 1 - exp(-K n exp(-lambda s)), with lambda and K fitted to labelled documents that the weights have
not seen. The surprise -ln P of the best segment and the sum over all segments give the score of the document
by a logistic curve that is fitted to the same documents; a text without segments has no surprise.

Fitting reads the whole texts of at most ``FIT_ROWS`` labelled documents of each class, those with the
smallest hashes of their id; each counts for as many labelled documents of its class as it stands for, so the
share of toxic documents is that of all labels at any size. Scoring reads all whole texts, in one narrow pass.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import WORD_BYTES, keep_rows, kept, pick, share, slices
from churnlake.llm.decontamination import character_spans

FIT_ROWS = 20_000
PRIOR, FLOOR = 10_000.0, 0.5
Z_MIN, ODDS_MIN, DRIFT = 2.5, 1.0, 0.2
BEGINNINGS = (6, 5, 4)
CACHE_WORDS = 150_000


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[bytes, float]
    rate: float  # lambda
    log_k: float
    curve: tuple[float, float, float]

    def chance(self, score: float, tokens: int) -> float:
        """P(a text of so many tokens from a document that is not toxic holds a segment of this score)."""
        expected = math.exp(min(self.log_k + math.log(max(tokens, 1)) - self.rate * score, 50.0))
        return max(-math.expm1(-expected), 1e-300)

    def evidence(self, scores: list[float], tokens: int) -> tuple[float, float]:
        """Surprise of the best segment, and of all segments together."""
        known = [-math.log(self.chance(s, tokens)) for s in scores]
        return max(known, default=0.0), sum(known)

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-min(max(a + b * best + c * math.log1p(total), -500.0), 500.0)))


def tokens_of(words: list[bytes]) -> set[bytes]:
    """The distinct words of a text and their beginnings, marked by a star that no word holds."""
    own = set(words)
    return own | {w[:n] + b"*" for w in own for n in BEGINNINGS if len(w) > n}


class Weights(dict):
    """Score of any word, 0 for one that does not stand out; keeps what it has looked up."""

    def __init__(self, known: dict[bytes, float]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> float:
        value = self.known.get(word)
        if value is None:
            heads = (self.known.get(word[:n] + b"*") for n in BEGINNINGS if len(word) > n)
            value = next((v for v in heads if v is not None), 0.0)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


def maximal_segments(places: list[int], values: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first token, token after the last, score) of all maximal-scoring segments, left to right.

    places, values: ascending tokens with their scores, of either sign; all others cost ``drift``. Every kept
    segment remembers the nearest one before it that begins lower, so the search skips what lies between
    and the scan stays linear.
    """
    kept: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest lower
    total, done = 0.0, 0
    for place, value in zip(places, values):
        before = total - drift * (place - done)
        total, done = before + value, place + 1
        if value <= 0:
            continue
        first = place
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= total:
                kept.append((first, place + 1, before, total, j))
                break
            first, before = kept[j][0], kept[j][2]
            del kept[j:]
            j = len(kept) - 1
    return [(first, end, after - before) for first, end, before, after, _ in kept]


def segments_of(words: list[bytes], weights: Weights) -> list[tuple[int, int, float]]:
    places, values = [], []
    for i, value in enumerate(map(weights.__getitem__, words)):
        if value:
            places.append(i)
            values.append(value)
    return maximal_segments(places, values)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.select(rows.doc_id.cast("long").alias("doc_id"), rows.text.cast("binary").alias("text"))


def _label_sample(labels: DataFrame, id_col: str, label_col: str, train: Column | None) -> tuple[DataFrame, tuple[float, float]]:
    """The sampled labels, and for each class how many labelled documents a sampled one stands for."""
    rows = pick(labels, doc_id=id_col, toxic=label_col).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    if train is not None:
        rows = rows.where(train)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).cast("int"))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id"), "doc_id"
    sample = rows.where("toxic = 1").orderBy(*order).limit(FIT_ROWS).union(
        rows.where("toxic = 0").orderBy(*order).limit(FIT_ROWS)
    )
    return sample, tuple(max(totals.get(toxic, 0) / FIT_ROWS, 1.0) for toxic in (0, 1))


def _fit_curve(x: np.ndarray, y: np.ndarray, stands_for: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of y on two columns, rows weighted by what they stand for, with a slight pull of the
    slopes to 0."""
    share = stands_for / stands_for.mean()
    x = np.column_stack([np.ones(len(x)), x])
    beta, pull = np.zeros(3), np.array([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (share * (y - p)) - pull * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    train: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Fit to labelled documents; train: which labels count, a condition over the column ``doc_id``.

    Rows without id or label do not count; a document with several labels is toxic if one says so. With
    labels of one class only (or none) every text scores the share of that class (0 for none).
    """
    sample, stands_for = _label_sample(labels, label_id_col, label_col, train)
    rows = _texts(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("text", "toxic", "fold")  # 2 * FIT_ROWS at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()
        for batch in slices(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[toxic].update(tokens_of((text or b"").translate(WORD_BYTES).split()))
        for toxic, known in enumerate(counts):
            items = list(known.items())
            for i in range(0, len(items), 50_000):
                words, n = zip(*items[i : i + 50_000])
                zeros = [0] * len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()), pa.array(n if toxic else zeros, pa.int64()), pa.array(zeros if toxic else n, pa.int64())],
                    ["token", "t", "o"],
                )

    counted = rows.where("fold > 0").select("text", "toxic").mapInArrow(count, "token binary, t long, o long")
    counted = counted.groupBy("token").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    total = counted.agg(F.sum("t"), F.sum("o"), F.count("*")).first()
    n_toxic, n_other, n_tokens = total[0] or 0, total[1] or 0, total[2]
    weights: dict[bytes, float] = {}
    if n_toxic and n_other:
        of_other, of_toxic = stands_for
        every = of_toxic * n_toxic + of_other * n_other
        prior = f"({FLOOR}D + {PRIOR}D * ({of_toxic!r}D * t + {of_other!r}D * o) / {every!r}D)"
        whole = f"{PRIOR + FLOOR * n_tokens}D"
        odds = f"ln((t + {prior}) / ({n_toxic} + {whole} - t - {prior})) - ln((o + {prior}) / ({n_other} + {whole} - o - {prior}))"
        scored = counted.selectExpr("token", f"{odds} AS odds", f"sqrt(1 / (t + {prior}) + 1 / (o + {prior})) AS error")
        scored = scored.where(f"abs(odds) >= {ODDS_MIN} AND abs(odds) >= {Z_MIN} * error")
        weights = {bytes(r["token"]): r["odds"] for r in scored.select("token", "odds").collect()}
    shared = share(docs.sparkSession.sparkContext, weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(shared, Weights)
        for batch in slices(batches):
            words = [(text or b"").translate(WORD_BYTES).split() for text in batch.column(0).to_pylist()]
            scores = [[s for _, _, s in segments_of(w, known)] for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array(scores, pa.list_(pa.float64()))],
                ["toxic", "n", "scores"],
            )

    held = rows.where("fold = 0").select("text", "toxic").mapInArrow(measure, "toxic int, n long, scores array<double>")
    held = sorted(held.collect(), key=lambda r: (r["toxic"], r["n"], r["scores"]))  # a quarter of 2 * FIT_ROWS rows
    stand = np.array([stands_for[r["toxic"]] for r in held])
    part = float(stand @ [r["toxic"] for r in held] / stand.sum()) if held else 0.0
    if part in (0.0, 1.0) or not weights:
        flat = math.log(max(part, 1e-9) / max(1 - part, 1e-9))
        return ToxicityModel({}, 1.0, 0.0, (flat, 0.0, 0.0))
    other = [(max(r["scores"], default=0.0), max(r["n"], 1)) for r in held if not r["toxic"]]
    best, length = np.array(other).T
    middle, high = np.quantile(best, [0.5, 0.9])
    rate = float(np.clip((math.log(-math.log(0.5)) - math.log(-math.log(0.9))) / max(high - middle, 1e-6), 0.2, 2.0))
    log_k = float(np.median(rate * best - np.log(length)) + math.log(math.log(2)))
    model = ToxicityModel(weights, rate, log_k, (0.0, 0.0, 0.0))
    facts = np.array([model.evidence(r["scores"], r["n"]) for r in held])
    facts[:, 1] = np.log1p(facts[:, 1])
    return ToxicityModel(weights, rate, log_k, _fit_curve(facts, np.array([r["toxic"] for r in held], float), stand))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), passages array<struct<start, end, score, p_value>> of every row.

    passages: the segments whose calibrated p-value in this text is at most 0.05, with character offsets.
    Null and empty texts hold no token and score what such a text deserves; repeated rows and null ids are
    rows like any other; an empty table gives no rows. Other columns, and the id, never enter a score.
    """
    shared = share(docs.sparkSession.sparkContext, (model.weights, model.rate, model.log_k, model.curve))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = kept(shared, lambda data: (ToxicityModel(*data), Weights(data[0])))
        for batch in slices(batches):
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                text = text or b""
                words = text.translate(WORD_BYTES).split()
                found = segments_of(words, known)
                scores.append(model.probability(*model.evidence([s for _, _, s in found], len(words))))
                passed = []
                for first, end, score in found:
                    chance = model.chance(score, len(words))
                    if chance <= 0.05:
                        passed.append((first, end, score, chance))
                where = character_spans(text, [(a, b) for a, b, _, _ in passed])
                passages.append([w | {"score": s, "p_value": p} for w, (_, _, s, p) in zip(where, passed)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"]
            )

    return _texts(docs, id_col, text_col).mapInArrow(
        run,
        "doc_id long, score double, passages array<struct<start: bigint, end: bigint, score: double, p_value: double>>",
    )


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with all their columns; the same scores as ``score_toxicity``, in one
    narrow pass without a join by id. Each row is judged by its own text; null and empty texts hold no token."""
    shared = share(docs.sparkSession.sparkContext, (model.weights, model.rate, model.log_k, model.curve))

    def make_test():
        model, known = kept(shared, lambda data: (ToxicityModel(*data), Weights(data[0])))

        def passes(text: bytes) -> bool:
            words = text.translate(WORD_BYTES).split()
            return model.probability(*model.evidence([s for _, _, s in segments_of(words, known)], len(words))) < threshold

        return passes

    return keep_rows(docs, text_col, make_test)
