"""Order statistics against sorting, on the narrowing path (a tiny ``small``) and the direct one."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnlake.operators import selection


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id long, v {kind}").repartition(4)


def check(spark, values, small, kind="double"):
    df = frame(spark, values, kind)
    known = sorted(v for v in values if v is not None)
    ranks = sorted({0, len(known) // 4, len(known) // 3, len(known) // 2, len(known) - 1})
    got = selection.order_statistics(df, {"v": F.col("v")}, {"v": ranks}, small=small)
    for r in ranks:
        stat = got[("v", r)]
        assert stat.value == known[r]
        assert stat.less == sum(v < known[r] for v in known)
        assert stat.equal == sum(v == known[r] for v in known)


@pytest.mark.parametrize("small", [50, 10**6])
def test_continuous(spark, small):
    rng = random.Random(1)
    check(spark, [rng.gauss(0, 1000) for _ in range(3000)], small)


@pytest.mark.parametrize("small", [20, 10**6])
def test_hot_value_and_nulls(spark, small):
    rng = random.Random(2)
    values = [7.0] * 1000 + [rng.choice([None, rng.random() * 14]) for _ in range(2000)]
    check(spark, values, small)


@pytest.mark.parametrize("small", [2, 10**6])
def test_few_integers(spark, small):
    check(spark, [i % 5 for i in range(2000)], small, "int")


def test_long_keys_beyond_double_precision(spark):
    base = 2**60
    check(spark, [base + i for i in range(500)] + [0, 2**62], 50, "bigint")


def test_coarse_sketch_still_exact(spark, monkeypatch):
    monkeypatch.setattr(selection, "ACCURACY", 20)
    rng = random.Random(3)
    check(spark, [rng.random() for _ in range(2000)], 200)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60))
def test_any_integers(spark, values):
    check(spark, values, 10, "int")


def test_quantiles_interpolate(spark):
    df = frame(spark, [1.0, 2.0, 4.0, 8.0])
    for small in (1, 10**6):
        got = selection.exact_quantiles(df, {"v": F.col("v")}, (0.0, 0.25, 0.5, 1.0), small=small)
        assert [got[("v", p)] for p in (0.0, 0.25, 0.5, 1.0)] == [1.0, 1.75, 3.0, 8.0]


def test_empty_series(spark):
    df = frame(spark, [None, None])
    assert selection.exact_quantiles(df, {"v": F.col("v")}, (0.5,)) == {("v", 0.5): None}


def test_rank_out_of_range(spark):
    with pytest.raises(ValueError):
        selection.order_statistics(frame(spark, [1.0]), {"v": F.col("v")}, {"v": [1]})


@pytest.mark.parametrize("small", [2, 10**6])
def test_row_cuts_break_ties_by_id(spark, small):
    values = [float(i % 3) for i in range(300)]
    df = frame(spark, values)
    order = sorted((v, i) for i, v in enumerate(values))
    cuts = selection.row_cuts(df, {"v": F.col("v")}, F.col("id"), {"v": [40, 150]}, {"v": 300}, small)
    for rank in (40, 150):
        after = df.where(cuts[("v", rank)].at_or_after(F.col("v"), F.col("id")))
        assert {r["id"] for r in after.collect()} == {i for _, i in order[rank:]}
