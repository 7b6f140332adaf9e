import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.llm import class_lm
from churnlake.llm.class_lm import best_classes, fit_class_model, score_texts
from churnlake.llm.common import id_remainder


def words(text):
    return (text or "").encode().lower().split()


def test_best_classes_against_one_by_one():
    pick = np.random.default_rng(0)
    n, k = 300, 7
    now, table = pick.integers(0, k - 2, n), pick.integers(40, 400, (k, k)).astype(float)
    before, after = pick.integers(0, 9, (2, n, k)).astype(float)
    for i, best in enumerate(best_classes(before, after, now, table, k - 2)):
        rest = table.copy()
        rest[now[i]] -= after[i]
        rest[:, now[i]] -= before[i]
        rest = np.maximum(rest, 0) + 0.5
        gain = np.log(rest) @ after[i] + before[i] @ np.log(rest)
        gain -= after[i].sum() * np.log(rest.sum(1)) + before[i].sum() * np.log(rest.sum(0))
        assert best == np.argmax(gain[: k - 2])


@pytest.mark.parametrize("listed", (1 << 18, 40))
def test_counts_and_base_score(spark, documents, odd_rows, listed, monkeypatch):
    monkeypatch.setattr(class_lm, "LISTED", listed)
    monkeypatch.setattr(class_lm, "CLUSTERED", min(listed, 20))
    monkeypatch.setattr(class_lm, "CLUSTER_COUNT", 1)
    rows = [(i, f"the Cat {i % 7} sat on the mat{i % 11} rare{i}") for i in range(100, 160)] + odd_rows
    docs = documents(rows).repartition(3)
    model = fit_class_model(docs, id_remainder(F.col("doc_id")) != 1, classes=4, passes=2)
    got = score_texts(docs, model).collect()
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            counts.update(words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    expected = sorted(
        (str(i), len(words(t)) + 1, sum(counts[w] > 0 for w in words(t)) + 1, round(sum(log(counts[w]) for w in words(t)) + log(ends), 6))
        for i, t in rows
    )
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == expected
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 and r.perplexity > 1 for r in got)


def test_probabilities_sum_to_one(spark, documents):
    rows = [(i, " ".join(f"w{(i * j) % 23}" for j in range(1, 12))) for i in range(80)]
    model = fit_class_model(documents(rows), classes=3, passes=2)
    assert np.allclose((10**model.transitions).sum(1), 1)
    of_word = model.classes[:-2]
    for c in set(of_word.tolist()):
        assert np.isclose((10 ** model.emissions[of_word == c]).sum(), 1)


def test_classes_beat_word_counts_on_held_out_text(spark, small):
    docs = small("documents")
    model = fit_class_model(docs, id_remainder(F.col("doc_id")) != 1)
    total = score_texts(docs, model).where(id_remainder(F.col("doc_id")) == 1).agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_empty(spark, documents):
    assert score_texts(documents([]), fit_class_model(documents([]))).collect() == []
    row = score_texts(documents([(1, "a b")]), fit_class_model(documents([]))).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and row.score < 0


@pytest.mark.parametrize("listed,arrays", [(1 << 17, 12), (20, 12), (20, 0)])
def test_words_beyond_the_arrays_get_classes_too(spark, documents, listed, arrays, monkeypatch):
    monkeypatch.setattr(class_lm, "LISTED", listed)
    monkeypatch.setattr(class_lm, "CLUSTERED", arrays)
    rows = [(i, " ".join(f"w{(i * j) % 53}" for j in range(1, 20)) + f" once{i}") for i in range(90)] + [(900, None), (901, "w1 new w2")]
    model = fit_class_model(documents(rows).repartition(3), F.col("doc_id") < 900, classes=4, passes=3)
    counts, bigrams = Counter(), Counter()
    for i, t in rows:
        if i < 900:
            counts.update(words(t))
    of = {w: int(k) for w, k in zip(model.vocabulary.listed, model.classes[:-2])}
    of |= {r["word"].encode(): r["class"] for r in model.words.collect() if r["class"] is not None}
    assert set(of) == {w for w, n in counts.items() if n >= class_lm.CLUSTER_COUNT} and len(of) > 40
    path = lambda t: [5, *(of.get(w, 4) for w in words(t)), 5]
    for i, t in rows:
        if i < 900:
            bigrams.update(zip(path(t), path(t)[1:]))
    table = np.array([[bigrams[a, b] for b in range(6)] for a in range(6)], float)
    weight = np.array([sum(n for w, n in counts.items() if of.get(w, 4) == k) for k in range(5)] + [90.0])
    prior = (weight + 0.5) / (weight + 0.5).sum()
    log = np.log10((table + class_lm.BACK_OFF * prior) / (table.sum(1, keepdims=True) + class_lm.BACK_OFF))
    assert np.allclose(log, model.transitions)
    divisor = weight[4] + 0.5 * (sum(w not in of for w in counts) + 1)
    for r in score_texts(documents(rows), model).collect():
        t = dict(rows)[r.doc_id]
        expected = sum(log[a, b] for a, b in zip(path(t), path(t)[1:]))
        expected += sum(math.log10(counts[w] / weight[of[w]]) if w in of else math.log10((counts[w] + 0.5) / divisor) for w in words(t))
        assert r.score == pytest.approx(expected, abs=1e-9)
