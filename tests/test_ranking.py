import itertools

import pytest
from pyspark.sql import functions as F

from churnlake.operators import curves
from churnlake.operators.ranking import descending_totals, slice_borders, slice_number


@pytest.mark.parametrize("slice_rows", [500_000, 100, 7])
def test_totals_match_a_plain_loop(spark, slice_rows):
    rows = [(g, i, (i * 7) % 11) for g, n in (("a", 900), ("b", 5), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, k int, x long").repartition(5)
    got = {(r["g"], r["k"]): r for r in descending_totals(df, ["g"], "k", ["x"], slice_rows).collect()}
    for g, group in itertools.groupby(rows, key=lambda r: r[0]):
        group, total = sorted(group, key=lambda r: -r[1]), 0
        for i, (_, k, x) in enumerate(group):
            total += x
            row = got[(g, k)]
            following = row["following"]["x"] if row["following"] else None
            assert (row["cum_x"], row["all_x"]) == (total, sum(r[2] for r in group))
            assert following == (group[i + 1][2] if i + 1 < len(group) else None)
    assert len(got) == len(rows)


def test_slices_are_sized_by_rows(spark):
    df = spark.range(8000).select(F.lit("only").alias("g"), F.col("id").alias("k"))
    borders = slice_borders(df, "k", 1000)
    sizes = df.groupBy(F.expr(slice_number("k", borders)).alias("s")).count().orderBy("s").collect()
    assert [r["s"] for r in sizes] == list(range(8)) and max(r["count"] for r in sizes) < 1100
    assert df.where("k = 7999").select(F.expr(slice_number("k", borders))).first()[0] == 0


def test_no_groups_and_empty_input(spark):
    df = spark.createDataFrame([(i, 1) for i in range(50)], "k int, x long")
    got = sorted((r["k"], r["cum_x"]) for r in descending_totals(df, [], "k", ["x"], 10).collect())
    assert got == [(i, 50 - i) for i in range(50)]
    assert descending_totals(df.where("k < 0"), [], "k", ["x"]).count() == 0


def test_a_curve_needs_one_exchange_of_distinct_scores(spark, monkeypatch):
    monkeypatch.setattr(curves, "descending_totals", lambda *a: descending_totals(*a, slice_rows=50))
    rows = spark.range(3000).selectExpr("pmod(id, 2) AS label", "pmod(id * 37, 1000) / 1000D AS score")
    points = curves.roc_points(rows, drop_collinear=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = curves.roc_points(rows, drop_collinear=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(_slice" in line]
    assert len(moved) <= 2 and "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    assert points.count() > 2
