import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnlake.llm import toxicity
from churnlake.llm.common import id_remainder
from churnlake.llm.toxicity import ToxicityModel, Weights, fit_toxicity, maximal_segments, score_toxicity, segments_of


def by_definition(scores):
    """Maximal segments by recursion: the best segment (shortest, leftmost), then what is left and right of it."""

    def search(low, high):
        best = None
        for i in range(low, high):
            total = 0.0
            for j in range(i, high):
                total += scores[j]
                if total > 0 and (best is None or total > best[2] + 1e-9 or abs(total - best[2]) < 1e-9 and j + 1 - i < best[1] - best[0]):
                    best = (i, j + 1, total)
        if best is None:
            return []
        return [*search(low, best[0]), best, *search(best[1], high)]

    return search(0, len(scores))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from((0, 0, 0, 3, 5, 11, -1, -7)), max_size=25))
def test_maximal_segments(values):
    drift = 2.0
    scores = [float(v) if v else -drift for v in values]
    places = [i for i, v in enumerate(values) if v]
    found = maximal_segments(places, [scores[i] for i in places], drift)
    assert sum(s for *_, s in found) == sum(s for *_, s in by_definition(scores))
    assert max((s for *_, s in found), default=0) == max((s for *_, s in by_definition(scores)), default=0)
    assert all(abs(sum(scores[a:b]) - s) < 1e-9 for a, b, s in found)
    assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def odds_by_definition(texts, toxic):
    """Log-odds of all words and beginnings with a Dirichlet prior of the whole sample, and their standard errors."""
    counts = Counter(), Counter()
    for text, label in zip(texts, toxic):
        own = set(text.split())
        counts[label].update(own | {w[:n] + "*" for w in own for n in (6, 5, 4) if len(w) > n})
    n = [sum(c.values()) for c in counts]
    every = set(counts[0]) | set(counts[1])
    prior = {w: 0.5 + 10_000 * (counts[0][w] + counts[1][w]) / sum(n) for w in every}
    whole = sum(prior.values())
    of = lambda w, k: math.log((counts[k][w] + prior[w]) / (n[k] + whole - counts[k][w] - prior[w]))
    error = lambda w: math.sqrt(sum(1 / (counts[k][w] + prior[w]) for k in (0, 1)))
    told = {w: (of(w, 1) - of(w, 0), error(w)) for w in every}
    return {w.encode(): odds for w, (odds, e) in told.items() if abs(odds) >= max(1.0, 2.5 * e)}


def test_weights_and_scores_against_brute_force(spark, documents):
    """Both signs: calm words stand only in texts that are not toxic."""
    rows, labels = corpus(3, 2400)
    rows = [(i, t if i % 6 == 0 else t + " kindly") for i, t in rows]
    docs = documents(rows).repartition(4)
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, told)
    fold = {r.doc_id: r.fold for r in told.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)).alias("fold")).collect()}
    own = [(t, labels[i][2]) for i, t in rows if fold[i]]
    expected = odds_by_definition(*zip(*own))
    assert set(model.weights) == set(expected) and min(expected.values()) < 0 < max(expected.values())
    assert all(model.weights[w] == pytest.approx(v) for w, v in expected.items())

    def facts(text):
        words, values = text.split(), []
        for w in words:
            heads = [w, *[w[:n] + "*" for n in (6, 5, 4) if len(w) > n]]
            values.append(next((expected[h.encode()] for h in heads if h.encode() in expected), -0.2))
        found = [s for *_, s in by_definition(values)]
        chances = [-math.expm1(-math.exp(model.log_k + math.log(len(words)) - model.rate * s)) for s in found]
        known = [-math.log(max(c, 1e-300)) for c in chances]
        return max(found, default=0.0), len(words), max(known, default=0.0), sum(known)

    # The extreme-value fit: two quantiles of the best scores of calibration texts that are not toxic.
    best, size = np.array([facts(t)[:2] for i, t in rows if not fold[i] and not labels[i][2]]).T
    middle, high = np.quantile(best, [0.5, 0.9])
    rate = min(max((math.log(math.log(2)) - math.log(-math.log(0.9))) / max(high - middle, 1e-6), 0.2), 2.0)
    assert model.rate == pytest.approx(rate)
    assert model.log_k == pytest.approx(np.median(rate * best - np.log(size)) + math.log(math.log(2)))
    # The curve: no better one nearby for the calibration texts.
    held = [(*facts(t)[2:], labels[i][2]) for i, t in rows if not fold[i]]
    loss = lambda c: sum(
        math.log1p(math.exp(-(2 * y - 1) * (c[0] + c[1] * b + c[2] * math.log1p(s)))) for b, s, y in held
    ) + 0.5 * (1e-6 * c[0] ** 2 + 1e-2 * (c[1] ** 2 + c[2] ** 2))
    for k in range(3):
        for step in (-1e-2, 1e-2):
            assert loss(model.curve) <= loss([c + step * (j == k) for j, c in enumerate(model.curve)]) + 1e-9
    text = dict(rows)
    for r in score_toxicity(docs, model).where("doc_id < 200").collect():
        _, _, top, total = facts(text[r.doc_id])
        a, b, c = model.curve
        assert r.score == pytest.approx(1 / (1 + math.exp(-(a + b * top + c * math.log1p(total)))), abs=1e-6)


def corpus(seed, n=900):
    pick = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{int(pick.random() ** 2 * 400)}" for _ in range(pick.randrange(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            at = pick.randrange(len(words))
            words[at:at] = [pick.choice(("idiot", "scum", "grubaro", "grubaxi", "gruban")) for _ in range(4)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_rows_and_passages(spark, documents):
    rows, labels = corpus(1)
    docs, labels = documents(rows).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    train = id_remainder(F.col("doc_id")) != 0
    model = fit_toxicity(docs, labels, train)
    got = score_toxicity(docs, model).where(~train).collect()
    right = sum((r.score >= 0.5) == (r.doc_id % 6 == 0) for r in got)
    assert len(got) > 100 and right >= 0.97 * len(got)
    text = dict(rows)
    found = [text[r.doc_id][p.start : p.end] for r in got if r.doc_id % 6 == 0 for p in r.passages]
    assert found and all({"idiot", "scum", "grubaro", "grubaxi", "gruban"} & set(f.split()) for f in found)


def test_given_documents(spark, small):
    docs, labels = small("documents"), small("labels")
    model = fit_toxicity(docs, labels, id_remainder(F.col("doc_id")) != 0)
    scored = score_toxicity(docs, model).join(labels, "doc_id")
    clean = scored.where("toxic = 0").agg(F.avg((F.col("score") >= 0.5).cast("int"))).first()[0]
    assert clean <= 0.05


def test_odd_rows_and_missing_classes(spark, documents, odd_rows):
    rows, labels = corpus(2, 300)
    kind = "doc_id long, quality int, toxic int"
    extra = [(None, 1, 1), (3, None, None), (0, 1, 0)]
    model = fit_toxicity(documents(rows), spark.createDataFrame(labels + extra, kind))
    got = score_toxicity(documents(odd_rows), model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score < 0.5 for r in got)
    assert score_toxicity(documents([]), model).collect() == []
    for some in ([], [x for x in labels if x[2] == 0]):
        flat = fit_toxicity(documents(rows), spark.createDataFrame(some, kind))
        assert {r.score < 0.5 for r in score_toxicity(documents(odd_rows), flat).collect()} == {True}


def test_a_bounded_sample_keeps_the_share_of_toxic_documents(spark, documents, monkeypatch):
    """A word in half of the toxic and a tenth of the other texts: two of five that hold it are toxic."""
    pick = random.Random(5)
    rows, labels = [], []
    for i in range(3200):
        toxic = i % 8 == 0
        words = [f"w{pick.randrange(300)}" for _ in range(20)]
        if pick.random() < (0.5 if toxic else 0.1):
            words[10] = "scum"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs, labels = documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for limit in (20_000, 300):
        monkeypatch.setattr(toxicity, "FIT_ROWS", limit)
        scored = score_toxicity(docs, fit_toxicity(docs, labels))
        assert abs(scored.agg(F.avg("score")).first()[0] - 0.125) < 0.04
        assert scored.where("score >= 0.5").count() == 0


def test_every_occurrence_scores(spark, documents):
    """A dense passage late in a text whose words stood far apart before, and one word four times."""
    toxic = ["idiot", "scum", "trash", "moron"]
    known = {w.encode(): 3.0 for w in toxic}
    assert segments_of([b"scum"] * 4, Weights(known)) == [(0, 4, 12.0)]
    quoted = [x for w in toxic for x in (*["calm"] * 60, w)]
    words = [*quoted, *["calm"] * 60, *toxic, *["calm"] * 60, *toxic]
    text = " ".join(words)
    model = ToxicityModel(known, 1.0, -2.0, (-3.0, 1.0, 0.0))
    row = score_toxicity(documents([(1, text), (2, " ".join(quoted))]), model).orderBy("doc_id").collect()
    assert [text[p.start : p.end] for p in row[0].passages] == [" ".join(toxic)] * 2
    assert row[0].score > 0.5 > row[1].score and not row[1].passages
