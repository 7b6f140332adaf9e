"""Names, missing values, text ids, artifacts, numerics and pruned plans."""

import math

import pytest
from pyspark.sql import functions as F

from churnlake.operators import curves, explain, folds, models, prep, profile, scoring
from churnlake.operators import forest_shap as forest
from churnlake.operators.split import stratified_folds, stratified_split
from churnlake.plans import explaining, inputs
from churnlake.schema import BANK_TABLE, CustomerTable
from churnlake.session import new_path, work_folder

SPEC = BANK_TABLE
LEVELS = ["A", "A B", "A_B", "中国", "日本", "it's `odd`"]


def test_levels_of_any_script_stay_apart(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(LEVELS)], "id long, c string")
    levels = prep.fit_levels(df, ["c"])
    coded = prep.one_hot(df, levels)
    assert len(coded.columns) == len(LEVELS)
    rows = [tuple(r)[1:] for r in coded.orderBy("id").collect()]
    assert rows[0] == (0,) * 5 and all(sum(r) == 1 for r in rows[1:]) and len(set(rows)) == len(LEVELS)


def test_equal_names_are_refused(spark):
    with pytest.raises(ValueError):
        prep.dummies({"a": ["", "b_c"], "a_b": ["", "c"]})


def test_columns_with_spaces_train_and_serve(spark, bank):
    wide = {"CreditScore": "Credit Score", "Geography": "Home Country", "Balance": "Balance.Now", "CustomerId": "Customer Id"}
    change = lambda v: wide.get(v, v) if isinstance(v, str) else tuple(wide.get(x, x) for x in v)
    spec = CustomerTable(**{k: None if v is None else change(v) for k, v in SPEC.__dict__.items()})
    renamed = bank.withColumnsRenamed(wide)
    fitted = models.fit_model(renamed, spec, "decision_tree")
    scores = scoring.batch_scores(fitted, renamed, spec)
    assert scores.count() == bank.count() and "Home Country_Germany" in fitted.preparation.features


def test_missing_values_from_training_to_serving(spark, bank):
    holes = bank.withColumns(
        {
            "Balance": F.when(F.col("CustomerId") % 7 != 0, F.col("Balance")),
            "Geography": F.when(F.col("CustomerId") % 5 != 0, F.col("Geography")),
        }
    )
    fitted = models.fit_model(holes, SPEC, "logistic_regression")
    batch = scoring.batch_scores(fitted, holes, SPEC).select("CustomerId", F.col("score").alias("a"))
    own = fitted.score(holes).select("CustomerId", F.col("score").alias("b"))
    row = batch.join(own, "CustomerId").agg(F.count("a").alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("gap")).first()
    assert row.n == bank.count() and row.gap < 1e-12
    assert folds.cross_validate(holes, SPEC, "decision_tree", folds=2).count() == 2


@pytest.mark.parametrize("small", (10, 1_000_000))
def test_text_ids_at_any_size(spark, small):
    rows = [(f"id-{i}", i % 3 == 0, (i % 20) / 20) for i in range(240)]
    df = spark.createDataFrame([(i, int(c), s) for i, c, s in rows], "id string, label int, score double")
    split = stratified_split(df, "label", "id", small=small)
    assert {(r.label, r["count"]) for r in split.where("split = 'test'").groupBy("label").count().collect()} == {(0, 32), (1, 16)}
    folds = stratified_folds(df, "label", "id", 4, small=small).groupBy("label", "fold").count().collect()
    assert sorted((r.label, r.fold, r["count"]) for r in folds) == [(c, f, n) for c, n in ((0, 40), (1, 20)) for f in range(4)]
    gain = curves.gain_table(df, "id", small=small).orderBy("decile").collect()
    assert [r.n for r in gain] == [24] * 10 and gain[-1].cumulative_gain == 1


def test_artifact_of_all_models_explains_like_the_originals(spark, bank):
    small = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "gradient_boosting": {"maxIter": 3}, "decision_tree": {}}
    fitted = {k: models.fit_model(bank, SPEC, k, **s) for k, s in small.items()}
    path = new_path(spark, "artifact")
    models.save_models(fitted, path)
    loaded = models.load_models(spark, path)
    assert {k: (m.kind, m.preparation) for k, m in loaded.items()} == {k: (m.kind, m.preparation) for k, m in fitted.items()}
    rows = bank.orderBy("CustomerId").limit(20)
    some = scoring.batch_scores(loaded["gradient_boosting"], rows, SPEC).orderBy("CustomerId").collect()
    assert some == scoring.batch_scores(fitted["gradient_boosting"], rows, SPEC).orderBy("CustomerId").collect()
    again = loaded["random_forest"]
    names, leaves = again.preparation.features, forest.model_leaves(spark, again.learner)
    inputs_ = forest.feature_rows(again, rows, "CustomerId")
    base = forest.forest_base_value(inputs_, leaves, names)
    shap = forest.forest_shap(inputs_, inputs_, leaves, "CustomerId", names)
    first = rows.first().CustomerId
    steps = explain.waterfall(shap, "CustomerId", base, first).orderBy("step").collect()
    score = fitted["random_forest"].score(rows).where(F.col("CustomerId") == first).first().score
    assert steps[-1]["after"] == pytest.approx(score, abs=1e-9)


def test_density_of_shifted_values(spark):
    rows = [(0, math.sin(i * 12.9898) * 3 + (i % 17) / 17) for i in range(2000)]
    near = spark.createDataFrame(rows, "label int, v double")
    far = near.withColumn("v", F.col("v") + 1e9)
    a = [r.density for r in profile.violin_density(near, "v", "label").orderBy("x").collect()]
    b = [r.density for r in profile.violin_density(far, "v", "label").orderBy("x").collect()]
    assert len(a) == 64 and max(abs(x - y) for x, y in zip(a, b)) < 1e-5
    empty = near.withColumn("v", F.lit(None).cast("double"))
    assert profile.violin_density(empty, "v", "label").collect() == []


def test_describe_decimals(spark):
    df = spark.createDataFrame([(1,), (2,), (6,)], "v int").select(F.col("v").cast("decimal(10,2)").alias("v"))
    (row,) = profile.describe(df).collect()
    assert (row["n"], row["mean"], row["min"], row["p50"], row["max"]) == (3, 3.0, 1.0, 2.0, 6.0)


def test_class_limit(spark):
    df = spark.createDataFrame([(i, i) for i in range(30)], "id long, label int")
    with pytest.raises(ValueError):
        stratified_split(df, "label", "id", class_limit=20)


@pytest.mark.parametrize("columns", ((), ("balance",), ("balance", "segment")))
def test_columns_that_nobody_asked_for_are_not_read(spark, monkeypatch, columns):
    plans = []

    def held(df, label="stage"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    monkeypatch.setattr(inputs, "staged", held)
    inputs.split_profile(spark, "/root/testdata/sf0.001", *columns)
    assert plans and all("l_orderkey" not in p and "p_type" not in p for p in plans)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Cluster:
        master = "local-cluster[2,1,1024]"
        applicationId = "x"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Cluster()

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        work_folder(Session())


def test_forest_explanations_use_all_training_customers(spark):
    """The background is the whole training part: its mean score is the base value."""
    fitted, _, _, background, leaves, _ = explaining._shap_of_test(spark, "/root/testdata/sf0.01")
    _, train, _ = explaining._fitted_forest(spark, "/root/testdata/sf0.01")
    assert background.count() == train.count() > 100
    base = forest.forest_base_value(background, leaves, fitted.preparation.features)
    assert base == pytest.approx(fitted.score(train).agg(F.avg("score")).first()[0])
