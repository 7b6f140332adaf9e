"""Golden confusion matrix, and properties of metrics and curves."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from churnlake.operators import curves, metrics


@pytest.fixture(scope="module")
def golden(spark):
    rows = [(1, 1)] * 186 + [(0, 0)] * 1540 + [(0, 1)] * 53 + [(1, 0)] * 221
    return spark.createDataFrame(rows, "label int, prediction int")


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        score = round(rng.random(), 2)
        rows.append((i, int(rng.random() < 0.1 + 0.5 * score), "noisy", score))
        rows.append((i, rows[-1][1], "tied", 0.5))
    return spark.createDataFrame(rows, "id long, label int, model string, score double")


def test_golden_rates(golden):
    row = metrics.with_rates(metrics.outcome_counts(golden)).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (186, 1540, 53, 221)
    assert round(row["accuracy"], 3) == 0.863
    assert round(row["precision"], 3) == 0.778
    assert round(row["recall"], 3) == 0.457
    assert round(row["f1"], 3) == 0.576
    assert round(row["specificity"], 3) == 0.967


def test_golden_report(golden):
    report = {r["class"]: r for r in metrics.classification_report(metrics.outcome_counts(golden)).collect()}
    assert [round(report["0"][c], 2) for c in ("precision", "recall", "f1")] == [0.87, 0.97, 0.92]
    assert [round(report["1"][c], 2) for c in ("precision", "recall", "f1")] == [0.78, 0.46, 0.58]
    assert round(report["macro avg"]["f1"], 2) == 0.75
    assert round(report["weighted avg"]["f1"], 2) == 0.85
    assert (report["0"]["support"], report["1"]["support"]) == (1593, 407)


def test_golden_matrix(golden):
    cells = metrics.confusion_matrix(metrics.outcome_counts(golden)).collect()
    assert {(r["actual"], r["predicted"]): r["n"] for r in cells} == {(0, 0): 1540, (0, 1): 53, (1, 0): 221, (1, 1): 186}


def test_no_predicted_positive(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    row = metrics.with_rates(metrics.outcome_counts(df)).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_recall_grows_as_the_threshold_falls(scores):
    rates = metrics.with_rates(metrics.threshold_counts(scores, [i / 20 for i in range(20)], ["model"]))
    steps = metrics.threshold_steps(rates, ["model"]).where("recall_change IS NOT NULL")
    assert steps.count() == 38 and steps.where("recall_change < 0").count() == 0


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(1, 0.4), (1, 0.41)], "label int, score double")
    assert metrics.threshold_counts(df, [0.4]).first()["tp"] == 1


def test_area_equals_the_exact_evaluator(scores):
    got = {r["model"]: r["auc"] for r in curves.roc_auc(scores, ["model"]).collect()}
    exact = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    assert got["noisy"] == pytest.approx(exact.evaluate(scores.where("model = 'noisy'")), abs=1e-12)
    assert got["tied"] == pytest.approx(0.5)


def test_area_under_transforms(scores):
    one = scores.where("model = 'noisy'")
    area = curves.roc_auc(one).first()["auc"]
    assert curves.roc_auc(one.withColumn("score", F.exp("score"))).first()["auc"] == pytest.approx(area, abs=1e-12)
    assert curves.roc_auc(one.withColumn("score", -F.col("score"))).first()["auc"] == pytest.approx(1 - area, abs=1e-12)


def test_area_is_null_with_one_class(scores):
    assert curves.roc_auc(scores.where("label = 1")).first()["auc"] is None


def test_empty_scores(scores):
    empty = scores.where("label = 7")
    assert curves.roc_auc(empty, ["model"]).count() == 0
    assert metrics.outcome_counts(empty.withColumn("prediction", F.lit(0))).first()["tp"] == 0


def _area(points):
    points = sorted((r["fpr"], r["tpr"]) for r in points)
    return sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(points, points[1:]))


def test_points_trace_the_area(scores):
    one = scores.where("model = 'noisy'")
    area = curves.roc_auc(one).first()["auc"]
    every = curves.roc_points(one).collect()
    corners = curves.roc_points(one, drop_collinear=True).collect()
    assert _area(every) == pytest.approx(area) and _area(corners) == pytest.approx(area)
    assert len(corners) <= len(every) == one.select("score").distinct().count() + 1


def test_collinear_points_go(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    points = curves.roc_points(spark.createDataFrame(rows, "label int, score double"), drop_collinear=True)
    kept = sorted(r["threshold"] for r in points.collect() if r["threshold"] is not None)
    assert kept == [0.4, 0.5, 0.7, 0.9]


@pytest.mark.parametrize("small", [3, 10**6])
def test_gain_table_matches_ntile(spark, scores, small):
    one = scores.where("model = 'noisy'").limit(1003)
    from pyspark.sql import Window

    tile = F.ntile(10).over(Window.orderBy(F.desc("score"), "id"))
    plain = one.withColumn("decile", tile).groupBy("decile").agg(F.count("*").alias("n"), F.sum("label").alias("churned"))
    expected = {r["decile"]: (r["n"], r["churned"]) for r in plain.collect()}
    got = {r["decile"]: r for r in curves.gain_table(one, "id", small=small).collect()}
    assert {d: (r["n"], r["churned"]) for d, r in got.items()} == expected
    assert got[10]["cumulative_gain"] == pytest.approx(1.0)


def test_gain_table_with_fewer_rows_than_tiles(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.1)], "id long, label int, score double")
    assert [(r["decile"], r["n"]) for r in curves.gain_table(df, "id").orderBy("decile").collect()] == [(1, 1), (2, 1)]


def test_best_threshold_prefers_f1_then_the_higher_cut(spark):
    rows = [(0.5, 0.5, 0.2, 0.3), (0.4, 0.4, 0.4, 0.4), (0.3, 0.3, 0.6, 0.4)]
    rates = spark.createDataFrame(rows, "threshold double, precision double, recall double, f1 double")
    assert metrics.best_threshold(rates).first()["threshold"] == 0.4
    assert metrics.best_threshold(rates, recall_floor=0.5).first()["threshold"] == 0.3
