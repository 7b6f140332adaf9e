"""Model quality on the planted bank, agreement with an independent solution, explanation checks."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import curves, explain, folds, metrics, models, scoring
from churnlake.operators import forest_shap as forest
from churnlake.operators.split import stratified_split, uniform_sample
from churnlake.schema import BANK_TABLE
from churnlake.session import new_path, staged

SPEC = BANK_TABLE
ID = SPEC.id


@pytest.fixture(scope="module")
def parts(bank):
    rows = staged(stratified_split(bank, SPEC.label, ID), "split")
    return rows.where("split = 'train'"), rows.where("split = 'test'")


@pytest.fixture(scope="module")
def fitted(parts):
    train, _ = parts
    preparation = models.fit_preparation(train, SPEC)
    settings = {
        "logistic_regression": {},
        "decision_tree": {},
        "random_forest": {"numTrees": 20, "maxDepth": 8},
        "gradient_boosting": {"maxIter": 12},
    }
    return {k: models.fit_model(train, SPEC, k, preparation, **s) for k, s in settings.items()}


@pytest.fixture(scope="module")
def quality(fitted, parts):
    held = staged(models.scored_table(fitted, parts[1], SPEC), "scored")
    rates = metrics.with_rates(metrics.outcome_counts(held, ["model"]))
    table = metrics.compare_models(rates, curves.roc_auc(held, ["model"]))
    return {r["model"]: r for r in table.collect()}


def test_quality_on_planted_signal(quality, parts):
    majority = models.majority_baseline(*parts, SPEC.label).first()
    assert majority["predicted_class"] == 0
    for kind in ("decision_tree", "random_forest", "gradient_boosting"):
        assert quality[kind]["accuracy"] >= 0.84 > majority["accuracy"]
    assert quality["random_forest"]["auc"] >= 0.82 and quality["gradient_boosting"]["auc"] >= 0.82
    assert sorted(r["place"] for r in quality.values()) == [1, 2, 3, 4]


def test_trees_find_the_planted_drivers(fitted):
    for kind in ("decision_tree", "random_forest", "gradient_boosting"):
        table = explain.feature_importance(fitted[kind].learner, fitted[kind].preparation.features)
        rows = table.collect()
        assert {r["feature"] for r in rows[:2]} == {"Age", "NumOfProducts"}
        assert sum(r["importance"] for r in rows) == pytest.approx(1)
        assert explain.importance_concentration(table).collect()[-1]["cumulative_share"] == pytest.approx(1)


def test_constant_year_is_left_out_unless_asked_for(parts):
    assert "Year" not in models.fit_preparation(parts[0], SPEC).features
    kept = models.fit_preparation(parts[0], SPEC, drop_constant=False, feature_set="extended").features
    assert len(kept) == 16 and kept[0] == "Year" and kept[-1] == "AgeTenure"


def test_logistic_regression_solves_the_penalised_objective(parts, fitted):
    train = parts[0]
    names = fitted["logistic_regression"].preparation.features
    rows = forest.feature_rows(fitted["logistic_regression"], train, ID).join(train.select(ID, SPEC.label), ID).toPandas()
    x = np.column_stack([rows[list(names)].to_numpy(), np.ones(len(rows))])
    y = rows[SPEC.label].to_numpy()
    penalty = np.diag([1.0] * len(names) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    model = fitted["logistic_regression"].learner
    assert np.allclose(np.append(model.coefficients.toArray(), model.intercept), w, atol=1e-4)


def test_saved_model_scores_alike(spark, parts, fitted):
    path = new_path(spark, "saved")
    models.save_model(fitted["random_forest"], path)
    again = models.load_model(spark, path)
    assert again.preparation.features == fitted["random_forest"].preparation.features
    before = fitted["random_forest"].score(parts[1]).select(ID, F.col("score").alias("a"))
    after = again.score(parts[1]).select(ID, F.col("score").alias("b"))
    assert before.join(after, ID).where("a = b").count() == 2000


def test_unseen_missing_and_extra_columns_are_scored(parts, fitted):
    new = parts[1].drop("HasCrCard", SPEC.label).withColumn("Geography", F.lit("Atlantis")).withColumn("x", F.lit(1))
    scores = scoring.batch_scores(fitted["random_forest"], new, SPEC)
    assert scores.where("score BETWEEN 0 AND 1").count() == 2000


def test_missing_values_can_be_filled(parts):
    train = parts[0].withColumn("Age", F.when(F.col("CustomerId") % 7 != 0, F.col("Age")))
    preparation = models.fit_preparation(train, SPEC, fill_missing=True)
    model = models.fit_model(train, SPEC, "decision_tree", preparation)
    assert model.score(train).where("score IS NULL").count() == 0


def test_cross_validation_covers_every_row(bank):
    table = folds.cross_validate(bank, SPEC, "decision_tree", 3).collect()
    assert sum(r["n"] for r in table) == 10000 and min(r["accuracy"] for r in table) > 0.82


def test_search_prefers_the_deeper_tree(bank):
    grid = [{"maxDepth": 1}, {"maxDepth": 5}]
    assert folds.search(bank, SPEC, "decision_tree", grid, 2).first()["setting"] == "maxDepth=5"


def shapley_by_definition(f, x, background):
    """Average over the background of the textbook formula."""
    d = len(x)
    phi = np.zeros(d)
    for z in background:
        def v(subset):
            return f([x[i] if i in subset else z[i] for i in range(d)])

        for i in range(d):
            others = [j for j in range(d) if j != i]
            for k in range(d):
                for s in itertools.combinations(others, k):
                    weight = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                    phi[i] += weight * (v({*s, i}) - v(set(s)))
    return phi / len(background)


@pytest.mark.parametrize("kind", ["decision_tree", "random_forest", "gradient_boosting"])
@pytest.mark.parametrize("limits", [(50_000, 200_000), (7, 1)])
def test_forest_shap_equals_the_definition(spark, kind, limits):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, size=(300, 4)).astype(float)
    label = ((points[:, 0] > 2) ^ (points[:, 1] + points[:, 2] > 5)).astype(float)
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(
        [(i, *map(float, p), float(y)) for i, (p, y) in enumerate(zip(points, label))],
        "id long, a double, b double, c double, d double, label double",
    )
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    extra = {"numTrees": 4} if kind == "random_forest" else {"maxIter": 4} if kind == "gradient_boosting" else {}
    learner = models.make_classifier(kind, 300, maxDepth=4, **{k: v for k, v in extra.items()}).fit(vectors)
    leaves = forest.model_leaves(spark, learner)

    def output(row):
        return sum(
            leaf.value
            for leaf in leaves
            if all(row[f] > c for f, c in leaf.low.items()) and all(row[f] <= c for f, c in leaf.high.items())
        )

    explained, background = df.where("id < 12"), df.where("id >= 285")
    got = forest.forest_shap(explained, background, leaves, "id", names, *limits).collect()
    table = {(r["id"], r["feature"]): r["shap_value"] for r in got}
    assert len(table) == len(got) == 48
    for i in range(12):
        expected = shapley_by_definition(output, points[i], points[285:])
        assert np.allclose([table[(i, n)] for n in names], expected, atol=1e-12)
    base = forest.forest_base_value(background, leaves, names, limits[0])
    assert base == pytest.approx(np.mean([output(p) for p in points[285:]]))
    scored = models.with_score(learner.transform(vectors)).select("id", "score").collect()
    outputs = {r["id"]: r["output"] for r in forest.forest_output(df, leaves, "id", names, limits[0]).collect()}
    for r in scored:
        o = outputs[r["id"]]
        probability = 1 / (1 + math.exp(-2 * o)) if kind == "gradient_boosting" else o
        assert probability == pytest.approx(r["score"], abs=1e-12)


def test_two_ways_to_partial_dependence_agree(spark, parts, fitted):
    model, test = fitted["random_forest"], parts[1].limit(400)
    test = staged(test, "some")
    grids = {"NumOfProducts": [1.0, 2.0, 3.0]}
    slow = explain.partial_dependence(test.select(*SPEC.numeric, *SPEC.categorical), grids, model.score).collect()
    scaled = forest.feature_rows(model, test, ID)
    place = model.preparation.features.index("NumOfProducts")
    expression = model.preparation.expressions[place].replace("NumOfProducts", "v")
    inner = [spark.range(1).selectExpr(f"{v}D AS v").selectExpr(expression).first()[0] for v in grids["NumOfProducts"]]
    leaves = forest.model_leaves(spark, model.learner)
    fast = forest.forest_partial_dependence(scaled, leaves, model.preparation.features, {"NumOfProducts": inner}).collect()
    a = [r["average_score"] for r in sorted(slow, key=lambda r: r["value"])]
    b = [r["average_score"] for r in sorted(fast, key=lambda r: r["value"])]
    assert np.allclose(a, b, atol=1e-12)


def test_a_sample_explained_against_itself_adds_up(spark, parts, fitted):
    model = fitted["random_forest"]
    sample = staged(uniform_sample(parts[1], ID, 100), "sample")
    rows, names = forest.feature_rows(model, sample, ID), model.preparation.features
    leaves = forest.model_leaves(spark, model.learner)
    base = forest.forest_base_value(rows, leaves, names)
    shap = staged(forest.forest_shap(rows, rows, leaves, ID, names), "shap")
    sums = shap.groupBy(ID).agg(F.sum("shap_value").alias("s"))
    gap = sums.join(model.score(sample), ID).select(F.max(F.abs(F.col("s") + base - F.col("score")))).first()[0]
    assert gap < 1e-9
    ranked = explain.shap_importance(shap).orderBy(F.desc("importance")).collect()
    assert {r["feature"] for r in ranked[:2]} == {"Age", "NumOfProducts"}
    one = sample.agg(F.min(ID)).first()[0]
    steps = explain.waterfall(shap, ID, base, one).orderBy("step").collect()
    assert steps[0]["before"] == pytest.approx(base)
    assert steps[-1]["after"] == pytest.approx(model.score(sample).where(F.col(ID) == one).first()["score"])


def test_dependence_grid(bank):
    grids = explain.dependence_grid(bank, ["NumOfProducts", "EstimatedSalary"], 20, small=50)
    assert grids["NumOfProducts"] == [1.0, 2.0, 3.0] and len(grids["EstimatedSalary"]) == 20


def test_linear_dependence_is_linear_in_the_margin(bank):
    grids = {"Age": [20.0, 30.0, 40.0]}
    rows = explain.partial_dependence(
        bank.select("Age", "Tenure"), grids, explain.score_column(F.col("Age") * 0.5 - F.col("Tenure"))
    )
    a, b, c = [r["average_score"] for r in rows.orderBy("value").collect()]
    assert b - a == pytest.approx(5) and c - b == pytest.approx(5)


def test_segments_cover_the_bank(bank):
    rows, profile = scoring.segments(bank, SPEC, models.fit_preparation(bank, SPEC), 3)
    assert rows.count() == 10000 and profile.agg(F.sum("n")).first()[0] == 10000


@pytest.mark.parametrize("width", [80, 300])
def test_forest_shap_of_wide_tables(spark, width):
    rng = np.random.default_rng(width)
    points = rng.integers(0, 2, size=(400, width)).astype(float)
    points[5, 3] = np.nan
    label = (np.nan_to_num(points[:, :6]).sum(1) + np.nan_to_num(points[:, width - 4 :]).sum(1) > 5).astype(float)
    names = [f"segment.{i} 'x'" for i in range(width)]
    kind = "id long, " + ", ".join(f"`{n}` double" for n in names)
    rows = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], kind)
    from pyspark.ml.linalg import Vectors

    vectors = spark.createDataFrame([(Vectors.dense(p), float(y)) for p, y in zip(np.nan_to_num(points), label)], ["features", "label"])
    learner = models.make_classifier("random_forest", 400, maxDepth=5, numTrees=5).fit(vectors)
    leaves = forest.leaf_table(spark, learner)
    shap = forest.forest_shap(rows.where("id < 6"), rows.where("id >= 300"), leaves, "id", names, 10, 40)
    table = {}
    for r in shap.collect():
        table.setdefault(r["id"], {})[r["feature"]] = r["shap_value"]
    used = sorted({c["feature"] for r in leaves.collect() for c in r["path"]})
    listed = forest.model_leaves(spark, learner)

    def output(row):
        above = lambda f, c: np.isnan(row[f]) or row[f] > c
        return sum(
            leaf.value for leaf in listed if all(above(f, c) for f, c in leaf.low.items()) and not any(above(f, c) for f, c in leaf.high.items())
        )

    base = np.mean([output(p) for p in points[300:]])
    assert len(used) > 20 and max(used) > 62
    for i in range(6):
        assert sum(table[i].values()) + base == pytest.approx(output(points[i]), abs=1e-12)
        assert all(table[i][names[f]] == 0 for f in range(width) if f not in used)
    # one leaf at a time is small enough for the definition
    leaf = max(listed, key=lambda x: len({*x.low, *x.high}))
    place = sorted({*leaf.low, *leaf.high})
    inside = lambda row, f: not (f in leaf.low and row[f] <= leaf.low[f]) and not (f in leaf.high and not row[f] <= leaf.high[f])
    one = forest.forest_shap(rows.where("id < 3"), rows.where("id >= 300"), [leaf], "id", names).collect()
    one = {(r["id"], r["feature"]): r["shap_value"] for r in one}
    flags = np.array([[float(inside(p, f)) for f in place] for p in points])
    for i in range(3):
        expected = shapley_by_definition(lambda v: leaf.value * float(all(v)), flags[i], flags[300:])
        assert np.allclose([one[(i, names[f])] for f in place], expected, atol=1e-12)
