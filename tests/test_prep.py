"""Preparation, profiling, splits and files on small frames and the planted bank."""

import math

import pytest
from pyspark.sql import functions as F

from churnlake.functions.expressions import nan_to_null
from churnlake.operators import prep, profile
from churnlake.operators.split import stratified_folds, stratified_split, test_counts, uniform_sample
from churnlake.schema import BANK, BANK_TABLE
from churnlake.session import new_path
from churnlake.sources.files import read_customers, write_customers

test_counts.__test__ = False


def test_one_hot_names_and_baseline(bank):
    levels = prep.fit_levels(bank, BANK_TABLE.categorical)
    assert levels == {"Geography": ["France", "Germany", "Spain"], "Gender": ["Female", "Male"]}
    assert prep.feature_names(BANK_TABLE, levels) == [
        "Year", "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember",
        "EstimatedSalary", "Geography_Germany", "Geography_Spain", "Gender_Male",
    ]
    coded = prep.one_hot(prep.drop_identifiers(bank, BANK_TABLE), levels)
    assert coded.columns[-3:] == ["Geography_Germany", "Geography_Spain", "Gender_Male"]


def test_null_and_unseen_level_get_zeros(spark):
    df = spark.createDataFrame([(1, None), (2, "Mars"), (3, "b")], "id long, c string")
    rows = prep.one_hot(df, {"c": ["a", "b"]}).orderBy("id").collect()
    assert [r["c_b"] for r in rows] == [0, 0, 1]


def test_scaling_has_zero_mean_and_unit_population_deviation(bank):
    scaling = prep.fit_scaling(bank, ["Age", "Balance", "Year"])
    row = prep.scale(bank, scaling).agg(
        F.avg("Age").alias("m"), F.stddev_pop("Age").alias("s"), F.max(F.abs("Year")).alias("y")
    ).first()
    assert row["m"] == pytest.approx(0, abs=1e-9) and row["s"] == pytest.approx(1) and row["y"] < 1e-9


def test_scaling_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    values = [r["v"] for r in prep.scale(df, prep.fit_scaling(df, ["v"])).collect()]
    assert values == [-1.0, None, 1.0]


def test_zero_denominator_gives_null(spark, bank):
    row = prep.add_derived(bank.limit(1).withColumn("EstimatedSalary", F.lit(-1.0)), BANK_TABLE).first()
    assert row["BalanceSalaryRatio"] is None and row["AgeTenure"] == row["Age"] * row["Tenure"]


@pytest.mark.parametrize("small", [2, 10**6])
def test_imputation(spark, small):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (4.0, "y"), (9.0, "y")], "v double, c string")
    fills = prep.fit_imputation(df, ["v"], ["c"], small)
    assert fills == {"v": 4.0, "c": "y"}
    assert prep.impute(df, fills).where("v IS NULL OR c IS NULL").count() == 0


def test_align_adds_drops_and_orders(spark):
    df = spark.createDataFrame([(1, 5, None, "junk")], "id long, b int, a double, extra string")
    out = prep.align(df, ["a", "missing", "b"], ["id"])
    assert out.columns == ["id", "a", "missing", "b"] and tuple(out.first()) == (1, 0.0, 0.0, 5.0)


def test_nan_counts_as_null(spark):
    df = nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2), (None, 3)], "v double, i int"))
    assert {r["column"]: r["nulls"] for r in profile.null_counts(df).collect()} == {"v": 2, "i": 0}


def test_describe_small_path_equals_narrowing(bank):
    columns = ["Age", "Balance", "EstimatedSalary", "NumOfProducts", "Year"]
    assert profile.describe(bank, columns, small=40).collect() == profile.describe(bank, columns).collect()


def test_describe_of_an_empty_table(bank):
    row = profile.describe(bank.where("Age < 0"), ["Age"]).first()
    assert (row["n"], row["mean"], row["p50"], row["max"]) == (0, None, None, None)


def test_histogram_counts_every_row(bank):
    table = profile.histogram(bank, ["Balance", "Age", "Year"], 7)
    sums = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.sum("n").alias("n")).collect()}
    assert sums == {"Balance": 10000, "Age": 10000, "Year": 10000} and table.count() == 21


def test_density_integrates_to_one(bank):
    rows = profile.violin_density(bank, "Age", "Exited", grid=128).collect()
    for label in (0, 1):
        points = sorted((r["x"], r["density"]) for r in rows if r["Exited"] == label)
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
        assert area == pytest.approx(1, abs=0.02)


def test_correlation(bank):
    r = {(x["x"], x["y"]): x["r"] for x in profile.correlation(bank, ["Age", "Exited", "Year"]).collect()}
    assert r[("Age", "Age")] == pytest.approx(1) and r[("Age", "Exited")] == r[("Exited", "Age")] > 0.2
    assert r[("Year", "Age")] is None and r[("Year", "Year")] is None


def test_correlation_with_missing_values(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, None), (3.0, None, 7.0), (4.0, 8.0, 5.0), (None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    r = {(x["x"], x["y"]): x["r"] for x in profile.correlation(df, ["a", "b", "c"]).collect()}
    assert r[("a", "b")] == pytest.approx(1) and r[("c", "c")] == pytest.approx(1)
    assert r[("b", "c")] is None


def test_constant_columns(bank):
    found = {r["column"]: r["is_constant"] for r in profile.constant_columns(bank).collect()}
    assert [c for c, v in found.items() if v] == ["Year"]


def test_segment_churn_flags_germany(bank):
    rows = {
        (r["dimension"], r["segment_value"]): r
        for r in profile.segment_churn(bank, "Exited", ["Geography", "NumOfProducts"]).collect()
    }
    assert rows[("Geography", "Germany")]["high_risk"] == 1 and rows[("Geography", "France")]["high_risk"] == 0
    assert sum(r["n"] for (d, _), r in rows.items() if d == "Geography") == 10000


def test_class_allotment_by_largest_remainder():
    assert test_counts({0: 1593 * 5 + 3, 1: 407 * 5}, 0.2) == {0: 1594, 1: 407}
    assert test_counts({0: 7963, 1: 2037}, 0.2) == {0: 1593, 1: 407}
    assert sum(test_counts({0: 7, 1: 5, 2: 3}, 0.2).values()) == 3


@pytest.mark.parametrize("small", [20, 10**6])
def test_split_is_exact_disjoint_and_repeatable(bank, small):
    once = stratified_split(bank, "Exited", "CustomerId", small=small)
    counts = {(r["split"], r["Exited"]): r["count"] for r in once.groupBy("split", "Exited").count().collect()}
    churned = counts[("test", 1)] + counts[("train", 1)]
    assert counts[("test", 0)] + counts[("test", 1)] == 2000
    assert abs(counts[("test", 1)] / 2000 - churned / 10000) < 1 / 2000
    again = stratified_split(bank.repartition(3), "Exited", "CustomerId")
    test_ids = {r[0] for r in once.where("split = 'test'").select("CustomerId").collect()}
    assert test_ids == {r[0] for r in again.where("split = 'test'").select("CustomerId").collect()}


@pytest.mark.parametrize("small", [20, 10**6])
def test_folds_are_contiguous_and_even(bank, small):
    folded = stratified_folds(bank, "Exited", "CustomerId", 5, small)
    rows = folded.groupBy("Exited", "fold").agg(F.count("*").alias("n"), F.min("CustomerId").alias("lo")).collect()
    for label in (0, 1):
        mine = sorted((r["fold"], r["n"], r["lo"]) for r in rows if r["Exited"] == label)
        assert [f for f, _, _ in mine] == [0, 1, 2, 3, 4]
        assert max(n for _, n, _ in mine) - min(n for _, n, _ in mine) <= 1
        assert [lo for _, _, lo in mine] == sorted(lo for _, _, lo in mine)


def test_split_of_tiny_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, y int")
    assert stratified_split(df, "y", "id").groupBy("split").count().count() == 2
    assert stratified_split(df.where("id > 9"), "y", "id").count() == 0


def test_sample_repeats(bank):
    one = {r[0] for r in uniform_sample(bank, "CustomerId", 100).select("CustomerId").collect()}
    two = {r[0] for r in uniform_sample(bank.repartition(5), "CustomerId", 100).select("CustomerId").collect()}
    assert one == two and len(one) == 100


@pytest.mark.parametrize("source", ["csv", "parquet"])
def test_file_round_trip(spark, bank, source):
    path = new_path(spark, source)
    write_customers(bank, path, source)
    back = read_customers(spark, path, BANK, source)
    assert back.schema == bank.schema
    assert back.exceptAll(bank).count() == 0 and back.count() == 10000


def test_csv_with_odd_values(spark):
    path = new_path(spark, "odd")
    row = (2025, 1, ' O"Neil, x ', 600, None, "", 40, 2, float("nan"), 1, 1, 0, 1e-7, 1)
    write_customers(spark.createDataFrame([row], BANK), path)
    back = read_customers(spark, path).first()
    assert back["Surname"] == ' O"Neil, x ' and back["Geography"] is None and back["Gender"] is None
    assert back["Balance"] is None and math.isclose(back["EstimatedSalary"], 1e-7)


def test_csv_with_another_header_is_refused(spark):
    path = new_path(spark, "wrong")
    spark.createDataFrame([(1, 2)], "a int, b int").write.option("header", True).csv(path)
    with pytest.raises(Exception):
        read_customers(spark, path).collect()
