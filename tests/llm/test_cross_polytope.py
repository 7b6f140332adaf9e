import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.llm.cross_polytope import nearest_axes, nearest_neighbours, rotate

KIND = "vec_id long, embedding array<float>, distance string"


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], "x") for i, v in vectors], KIND)


def brute(vectors, queries, k):
    out = {}
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], np.float32).astype(float)
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
        out[q] = list(zip(ids[order].tolist(), d[order].tolist()))
    return out


def test_rotation_keeps_lengths_and_probes_are_ordered():
    x = np.random.default_rng(1).normal(size=(50, 24))
    assert np.allclose(np.linalg.norm(rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))
    turned = rotate(x, 3)
    sides = np.stack([turned, -turned], 2).reshape(50, -1)
    axes = nearest_axes(x, 3, 5)
    assert np.array_equal(axes, np.argsort(-sides, axis=1, kind="stable")[:, :5])


def test_recall_and_scores(spark, small):
    rows = small("embeddings").select("vec_id", "embedding").collect()
    vectors = [(r.vec_id, r.embedding) for r in rows]
    exact = brute(vectors, [i for i, _ in vectors if i % 50 == 0], 10)
    found = nearest_neighbours(small("embeddings"), F.col("vec_id") % 50 == 0, k=10).collect()
    distance = {}
    for q, near in brute(vectors, list(exact), len(vectors)).items():
        distance |= {(q, i): d for i, d in near}
    hits = 0
    for r in found:
        assert r.score == pytest.approx(distance[r.query_id, r.vec_id], rel=1e-12)
        hits += r.vec_id in {i for i, _ in exact[r.query_id]}
    assert len(found) == 10 * len(exact) and hits >= 0.9 * len(found)


def test_hot_vector_and_ties(spark):
    vectors = [(i, [1.0, 0, 0]) for i in range(60)] + [(100 + i, [0, 1.0, i / 10]) for i in range(20)]
    found = nearest_neighbours(table(spark, vectors), F.col("vec_id") == 0, k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, 0.0) for i in range(1, 6)]


def test_few_rows_are_all_found(spark):
    """Opposite vectors share no bucket with one probe; what is missing is answered exactly."""
    vectors = [(0, [1, 0, 0, 0]), (1, [-1, 0, 0, 0]), (2, [0, 5, 0, 0]), (3, [0, 0, 0, -3])]
    found = nearest_neighbours(table(spark, vectors), F.col("vec_id") < 2, k=10, tables=1, probes=1).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute(vectors, [0, 1], 10)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1, 2]), (2, [2, 1]), (3, None), (4, [0, 0]), (5, [nan, 1]), (6, [inf, 1]), (None, [1, 1]), (7, [None, 1]), (2, [2, 1])]
    found = nearest_neighbours(table(spark, vectors), F.lit(True), k=3).collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == [(1, 2), (2, 1)]
    assert nearest_neighbours(table(spark, []), F.lit(True)).collect() == []
    assert nearest_neighbours(table(spark, [(1, [1, 2])]), F.col("vec_id") == 1).collect() == []


def test_cutting_buckets_changes_nothing(spark, small, monkeypatch):
    vectors = small("embeddings").where("vec_id < 200")
    whole = sorted(nearest_neighbours(vectors, F.col("vec_id") % 4 == 0, k=4).collect())
    monkeypatch.setattr("churnlake.llm.cross_polytope.PART_ROWS", 3)
    monkeypatch.setattr("churnlake.llm.cross_polytope.PART_QUERIES", 2)
    assert sorted(nearest_neighbours(vectors, F.col("vec_id") % 4 == 0, k=4).collect()) == whole
