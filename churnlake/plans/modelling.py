"""Registered queries: fitting, validating, saving and applying classifiers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.functions.expressions import doubles
from churnlake.operators import deep_forest, explain, folds, models, newton_boosting, prep, scoring
from churnlake.operators import forest_shap as forest
from churnlake.plans.inputs import (
    ID,
    LABEL,
    PROFILE_CTE,
    SPEC,
    held_profile,
    rounded,
    split_profile,
    whole_split,
    with_profile,
    with_split,
)
from churnlake.plans.registry import query
from churnlake.session import new_path, staged

def _parts(spark, folder) -> tuple[DataFrame, DataFrame]:
    rows = whole_split(spark, folder)
    return rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")


def _fit(train: DataFrame, kind: str) -> models.Fitted:
    return models.fit_model(train, SPEC, kind)


_CALIBRATION = (
    "select count(*) as n, cast(sum(exited) as bigint) as churned, round(avg(exited), 4) as mean_score "
    "from split where split = 'train'"
)


def _calibration(spark, folder, kind: str) -> DataFrame:
    train, _ = _parts(spark, folder)
    scored = _fit(train, kind).score(train)
    return scored.agg(
        F.count("*").alias("n"),
        F.sum(F.col(LABEL)).cast("bigint").alias("churned"),
        F.round(F.avg("score"), 4).alias("mean_score"),
    )


@query("m1_logistic_regression", with_split(_CALIBRATION))
def logistic_regression(spark, folder):
    """With a free intercept the fitted mean probability equals the churn rate of the training rows."""
    return _calibration(spark, folder, "logistic_regression")


@query("m2_decision_tree", with_split(_CALIBRATION))
def decision_tree(spark, folder):
    """Leaf probabilities are class shares, so their mean is the churn rate of the training rows."""
    return _calibration(spark, folder, "decision_tree")


@query(
    "m1_logistic_quality",
    with_split(
        """select cast(6 + count(distinct geography) - 1 + count(distinct segment) - 1 as bigint) as n_features,
  cast(0 as bigint) as steep from split where split = 'train'"""
    ),
)
def logistic_quality(spark, folder):
    """At the fitted weights the gradient of the penalised loss is nearly 0 in every feature."""
    train, _ = _parts(spark, folder)
    fitted = _fit(train, "logistic_regression")
    weights, names = fitted.learner.coefficients.toArray().tolist(), fitted.preparation.features
    rows = fitted.score(train).select(
        (F.col("score") - F.col(LABEL)).alias("gap"), vector_to_array("features").alias("x")
    )
    slopes = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("gap") * F.col("x")[i]).alias(f"g{i}") for i in range(len(names))])
    slope = F.array(*[(F.col(f"g{i}") + F.lit(w)) / F.col("n") for i, w in enumerate(weights)])
    return slopes.select(
        F.lit(len(names)).cast("bigint").alias("n_features"),
        F.size(F.filter(slope, lambda v: F.abs(v) > 1e-4)).cast("bigint").alias("steep"),
    )


@query("m2_tree_quality", with_split("select count(*) as n, cast(0 as bigint) as off from split where split = 'train'"))
def tree_quality(spark, folder):
    """The score of a leaf is the churn share of its training rows, whichever rows share that score."""
    train, _ = _parts(spark, folder)
    leaves = _fit(train, "decision_tree").score(train).groupBy("score").agg(
        F.count("*").alias("k"), F.avg(F.col(LABEL)).alias("share")
    )
    return leaves.agg(
        F.sum("k").alias("n"), F.sum(F.when(F.abs(F.col("share") - F.col("score")) > 1e-9, F.col("k")).otherwise(0)).alias("off")
    )


_SAME_SCORES = with_split("select count(*) as n, count(*) as same_score from split where split = 'test'")


def _scores_of_leaves(spark, folder, kind: str) -> DataFrame:
    """Test rows, and those whose score from the pipeline is that of the leaves they fall into."""
    train, test = _parts(spark, folder)
    fitted = _fit(train, kind)
    rows = staged(forest.feature_rows(fitted, test, ID), "inputs")
    outputs = forest.forest_output(rows, forest.leaf_table(spark, fitted.learner), ID, fitted.preparation.features)
    output = F.col("output")
    if kind != "random_forest":  # boosted trees add up to half the log-odds
        output = F.lit(1.0) / (F.lit(1.0) + F.exp(output * -2))
    both = fitted.score(test).select(ID, "score").join(outputs, ID, "left")
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("score") - output) < 1e-9).alias("same_score"))


@query("m3_random_forest", _SAME_SCORES)
def random_forest(spark, folder):
    return _scores_of_leaves(spark, folder, "random_forest")


@query("m4_gradient_boosting", _SAME_SCORES)
def gradient_boosting(spark, folder):
    return _scores_of_leaves(spark, folder, "gradient_boosting")


@query("m5_boosted_deep", _SAME_SCORES)
def boosted_deep(spark, folder):
    return _scores_of_leaves(spark, folder, "boosted_deep")


@query(
    "m3_deep_forest",
    with_split("select count(*) as n, cast(sum(exited) as bigint) as churned, cast(0 as bigint) as mixed from split where split = 'train' and exited is not null"),
)
def deep_forest_leaves(spark, folder):
    """A forest without a limit of depth, on all training rows: each training row scores the share of churned rows among
    those that no cut tells from it, which holds if and only if leaves are pure or cannot be split."""
    train, _ = _parts(spark, folder)
    known = train.where(F.col(LABEL).isNotNull())
    forest_ = deep_forest.fit_deep_forest(known, SPEC, trees=10, bootstrap=False)
    names = forest_.preparation.features
    rows = staged(forest.feature_rows(forest_, known, ID), "inputs")
    outputs = forest.forest_output(rows, forest_.leaves, ID, names)
    told = rows.select(ID, F.expr(forest_.bins_sql([f"`{n}`" for n in names])).alias("bins")).join(known.select(ID, LABEL), ID).join(outputs, ID)
    alike = told.groupBy("bins").agg(
        F.count("*").alias("k"), F.sum(LABEL).alias("c"), F.max(F.abs(F.col("output"))).alias("high"), F.min("output").alias("low")
    )
    gap = F.greatest(F.abs(F.col("high") - F.col("c") / F.col("k")), F.abs(F.col("low") - F.col("c") / F.col("k")))
    return alike.agg(
        F.sum("k").alias("n"), F.sum("c").cast("bigint").alias("churned"), F.sum(F.when(gap > 1e-9, F.col("k")).otherwise(0)).alias("mixed")
    )


@query(
    "m5_newton_boosting",
    with_split(
        "select cast(r + 1 as int) as round, count(*) as n, cast(sum(exited) as bigint) as churned, cast(0 as bigint) as wrong_leaves, "
        "1 as loss_falls from split, range(8) t(r) where split = 'train' and exited is not null group by r"
    ),
)
def newton_boosting_rounds(spark, folder):
    """For each tree: the training rows in its leaves and their churned rows, the leaves whose weight is not -G / (H + 1) by a
    fresh count over all training rows, scored from their features, and whether the log-loss fell."""
    train, _ = _parts(spark, folder)
    model = newton_boosting.fit_newton_boosting(train, SPEC, rounds=8, depth=3, rate=0.3, penalty=1.0)
    names = [f"x_{i}" for i in range(len(model.preparation.features))]
    inputs = train.where(F.col(LABEL).isNotNull()).selectExpr(
        f"CAST({LABEL} AS double) AS y", *[f"{e} AS {n}" for e, n in zip(model.preparation.expressions, names)]
    )
    steps = ", ".join(f"struct({model.margin_sql(r)} AS m, {t.weight_sql(names)} AS w)" for r, t in enumerate(model.trees))
    told = inputs.selectExpr("y", f"posexplode(array({steps})) AS (r, c)").selectExpr(
        "r", "y", "c.w AS w", "1D / (1D + exp(-c.m)) AS p"
    )
    leaves = told.groupBy("r", "w").agg(
        F.sum(F.expr("p - y")).alias("g"), F.sum(F.expr("p * (1 - p)")).alias("h"), F.count("*").alias("n"), F.sum("y").alias("y")
    )
    falls = doubles([float(b < a) for a, b in zip(model.losses, model.losses[1:])])[F.col("r")].cast("int")
    return leaves.groupBy("r").agg(
        F.sum("n").alias("n"),
        F.sum("y").cast("bigint").alias("churned"),
        F.count_if(F.abs(F.col("w") + 0.3 * F.col("g") / (F.col("h") + 1.0)) > 1e-9).alias("wrong_leaves"),
    ).select((F.col("r") + 1).alias("round"), "n", "churned", "wrong_leaves", falls.alias("loss_falls"))


@query(
    "m6_predicted_class",
    with_split("select count(*) as n, count(*) as agreeing from split where split = 'test'"),
)
def predicted_class(spark, folder):
    """The predicted class is 1 exactly where the probability exceeds one half."""
    train, test = _parts(spark, folder)
    scored = _fit(train, "decision_tree").score(test)
    return scored.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("prediction") == (F.col("score") > 0.5).cast("int")).alias("agreeing"),
    )


@query(
    "m7_probability",
    with_split("select split, count(*) as n, count(*) as in_unit from split group by split"),
)
def probability(spark, folder):
    train, test = _parts(spark, folder)
    scored = _fit(train, "logistic_regression").score(train.unionByName(test))
    return scored.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("score").between(0.0, 1.0)).alias("in_unit")
    )


_FOLDS = """with {profile},
folds as (
  select (row_number() over (partition by exited order by customer_id) - 1) * {k}
    // count(*) over (partition by exited) as fold from profile)"""


def _fold_sizes(k: int, body: str) -> str:
    return _FOLDS.format(profile=PROFILE_CTE, k=k) + body


_FIVE = _fold_sizes(
    5,
    " select cast(fold as int) as fold, count(*) as n, cast(sum(exited) as bigint) as churned, 1 as recounted, 1 as calibrated "
    "from folds group by fold",
).replace("from profile)", ", exited from profile)")


def _folds(spark, folder, **options) -> DataFrame:
    """Per fold: its rows and churned rows as predicted, whether the accuracy is the one counted again from the staged
    predictions, and whether the fold's model gives its training rows their churn rate on average, as the minimum with a
    free intercept does."""
    settings = {k: v for k, v in options.items() if k != "scaled"}
    table = folds.fold_table(held_profile(spark, folder), SPEC, 5, options.get("scaled", True))
    predictions = folds.fold_predictions(table, "logistic_regression", [settings])
    again = predictions.groupBy("fold").agg(
        F.count("*").alias("rows"),
        F.sum("label").cast("bigint").alias("churned"),
        F.count_if(F.col("label") == F.col("prediction")).alias("right"),
    )
    same = (F.col("n") == F.col("rows")) & (F.abs(F.col("accuracy") * F.col("n") - F.col("right")) < 1e-6)
    weights = folds.fit_logistic_folds(table, [settings])
    sums = []
    for k, p in table.preparations.items():
        w = weights[(0, k)]
        margin = " + ".join([f"{float(w[-1])!r}D", *[f"({float(a)!r}D) * ({e})" for a, e in zip(w, p.expressions)]])
        sums.append(F.expr(f"avg(CASE WHEN fold <> {k} THEN 1D / (1D + exp(-({margin}))) - label END)"))
    gaps = table.rows.agg(*sums).first()
    calibrated = F.lit(0)
    for k, gap in zip(table.preparations, gaps):
        calibrated = F.when(F.col("fold") == k, int(abs(gap) < 1e-6)).otherwise(calibrated)
    return folds.fold_accuracies(predictions).join(again, "fold").select(
        "fold", "n", "churned", same.cast("int").alias("recounted"), calibrated.alias("calibrated")
    )


@query("m8_cross_validation", _FIVE)
def cross_validation(spark, folder):
    return _folds(spark, folder)


@query("m8_cross_validation_unscaled", _FIVE)
def cross_validation_unscaled(spark, folder):
    return _folds(spark, folder, scaled=False, maxIter=5000)


_TREES = [{"maxDepth": d, "minInstancesPerNode": m} for d in (2, 4) for m in (1, 20)]


def _recounted(predictions: DataFrame, settings) -> DataFrame:
    """setting, mean_again, lowest_again, n: from the staged predictions alone."""
    name = F.element_at(F.array(*[F.lit(x) for x in folds.setting_names(settings)]), F.col("setting") + 1)
    by_fold = predictions.groupBy(name.alias("setting"), "fold").agg(
        F.count("*").alias("k"), (F.count_if(F.col("label") == F.col("prediction")) / F.count("*")).alias("a")
    )
    return by_fold.groupBy("setting").agg(F.sum("k").alias("n"), F.avg("a").alias("mean_again"), F.min("a").alias("lowest_again"))


@query(
    "m9_search",
    with_profile(
        "select setting, n, 1 as same, 1 as in_order from (select count(*) as n from profile where exited is not null), "
        f"(values {', '.join(repr((x,)).replace(',)', ')') for x in folds.setting_names(_TREES))}) v(setting)"
    ),
)
def search(spark, folder):
    """For each setting: the rows it was validated on, whether its mean and lowest accuracy are those counted again from
    the fold predictions, and whether it stands where its mean belongs."""
    rows = held_profile(spark, folder)
    table = folds.fold_table(rows, SPEC, 3)
    predictions = folds.fold_predictions(table, "decision_tree", _TREES)
    found = folds.search(rows, SPEC, "decision_tree", _TREES, folds=3)
    found = found.withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))  # four rows
    again = _recounted(predictions, _TREES)
    rank = F.row_number().over(Window.orderBy(F.desc("mean_again"), "setting"))  # four rows
    both = found.join(again.withColumn("rank", rank), "setting")
    same = (F.abs(F.col("mean_accuracy") - F.col("mean_again")) < 1e-9) & (F.abs(F.col("lowest_accuracy") - F.col("lowest_again")) < 1e-9)
    return both.select("setting", "n", same.cast("int").alias("same"), (F.col("place") == F.col("rank")).cast("int").alias("in_order"))


_PENALTIES = [{"regParam": 10.0**-i} for i in range(9)]


@query(
    "m9_halving_search",
    with_profile(
        "select rung, count(*) as n, settings, kept, 1 as same, 1 as best_kept from (select *, substr(md5(cast(customer_id as varchar) || ':42'), 1, 13) as k "
        "from profile where exited is not null) p, (values (0, "
        f"'{-(-2**52 // 9):013x}', cast(9 as bigint), cast(3 as bigint)), (1, '{-(-2**52 // 3):013x}', cast(3 as bigint), cast(1 as bigint)), "
        "(2, 'g', cast(1 as bigint), cast(1 as bigint))) r(rung, top, settings, kept) where p.k < r.top group by all"
    ),
)
def halving_search(spark, folder):
    """Nine penalties on a ninth of the customers, the best three on a third, the best of these on all: rows and settings
    of each rung, whether means are those of the staged predictions, and whether none that went is better than one kept."""
    found = folds.halving_search(held_profile(spark, folder), SPEC, "logistic_regression", _PENALTIES)
    parts, tried = [], folds.setting_names(_PENALTIES)
    for rung, predictions in found.predictions.items():
        names = [r["setting"] for r in found.rungs.where(F.col("rung") == rung).collect()]  # at most nine rows
        settings = [_PENALTIES[tried.index(x)] for x in names]
        parts.append(_recounted(predictions, settings).withColumn("rung", F.lit(rung)))
    again = parts[0].unionByName(parts[1]).unionByName(parts[2])
    both = found.rungs.join(again, ["rung", "setting"])
    worst = F.min(F.when(F.col("kept"), F.col("mean_again")))
    gone = F.coalesce(F.max(F.when(~F.col("kept"), F.col("mean_again"))), F.lit(0.0))
    return both.groupBy("rung").agg(
        F.min("n").alias("n"),
        F.count("*").alias("settings"),
        F.count_if(F.col("kept")).alias("kept"),
        F.min((F.abs(F.col("mean_accuracy") - F.col("mean_again")) < 1e-9).cast("int")).alias("same"),
        (worst >= gone - F.lit(1e-12)).cast("int").alias("best_kept"),
    )


@query(
    "m10_scored_models",
    with_split(
        "select model, count(*) as n, cast(sum(exited) as bigint) as churned "
        "from split, (values ('decision_tree'), ('logistic_regression')) m(model) where split = 'test' group by model"
    ),
)
def scored_models(spark, folder):
    train, test = _parts(spark, folder)
    laid_out, preparation = models.training_table(train, SPEC), models.fit_preparation(train, SPEC)
    kinds = ("logistic_regression", "decision_tree")
    fitted = {kind: models.fit_model(train, SPEC, kind, preparation, laid_out=laid_out) for kind in kinds}
    table = models.scored_table(fitted, test, SPEC)
    return table.where(F.col("score").isNotNull()).groupBy("model").agg(
        F.count("*").alias("n"), F.sum("label").cast("bigint").alias("churned")
    )


@query(
    "m11_majority_baseline",
    with_split(
        """, top as (
  select exited from split where split = 'train' group by exited order by count(*) desc, exited limit 1)
select any_value(top.exited) as predicted_class, count(*) as n,
  round(avg(case when split.exited = top.exited then 1e0 else 0e0 end), 6) as accuracy
from split, top where split = 'test'"""
    ),
)
def majority_baseline(spark, folder):
    rows = split_profile(spark, folder)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    return rounded(models.majority_baseline(train, test, LABEL))


@query(
    "s3_model_round_trip",
    with_split(
        """, f as (select 6 + count(distinct geography) - 1 + count(distinct segment) - 1 as k from split where split = 'train'),
n as (select count(*) as n from split where split = 'test')
select model, n, n as same_score, cast(k as bigint) as n_features from f, n, (values ('logistic_regression'),
  ('decision_tree'), ('random_forest'), ('gradient_boosting'), ('boosted_deep')) m(model)"""
    ),
)
def model_round_trip(spark, folder):
    """All models saved as one artifact and reloaded give every test row the same score."""
    train, test = _parts(spark, folder)
    preparation = models.fit_preparation(train, SPEC)
    fitted = {kind: models.fit_model(train, SPEC, kind, preparation) for kind in models.MODEL_KINDS}
    path = new_path(spark, "models")
    models.save_models(fitted, path)
    reloaded = models.load_models(spark, path)
    before = models.scored_table(fitted, test, SPEC).select(ID, "model", F.col("score").alias("before"))
    after = models.scored_table(reloaded, test, SPEC).select(ID, "model", F.col("score").alias("after"))
    sizes = [F.when(F.col("model") == k, len(m.preparation.features)) for k, m in reloaded.items()]
    return before.join(after, [ID, "model"]).groupBy("model").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("before") == F.col("after")).alias("same_score"),
        F.first(F.coalesce(*sizes)).cast("bigint").alias("n_features"),
    )


@query(
    "b1_batch_scores",
    with_split("select count(*) as n, count(*) as scored, count(*) as classified from split where split = 'test'"),
)
def batch_scores(spark, folder):
    """New records lack a training column and carry an unknown one; all of them get a score."""
    train, test = _parts(spark, folder)
    new = test.drop("has_urgent", LABEL, "split").withColumn("campaign", F.lit("spring"))
    table = scoring.batch_scores(_fit(train, "random_forest"), new, SPEC)
    return table.agg(
        F.count("*").alias("n"),
        F.count("score").alias("scored"),
        F.count_if(F.col("prediction").isin(0, 1)).alias("classified"),
    )


def _holes(rows: DataFrame) -> DataFrame:
    return rows.withColumns(
        {
            "balance": F.when(F.col("balance") >= 0, F.col("balance")),
            "segment": F.when(F.col("segment") != "BUILDING", F.col("segment")),
        }
    )


@query(
    "b1_missing_values",
    with_split(
        """select count(*) as n, count(*) as scored, count(*) as like_filled,
  cast(sum(case when balance < 0 or segment = 'BUILDING' then 1 else 0 end) as bigint) as with_holes
from split where split = 'test'"""
    ),
)
def missing_values(spark, folder):
    """Training and serving with holes: a record with a hole scores like one that holds the training
    median, or the most frequent training level."""
    train, test = _parts(spark, folder)
    train, test = _holes(train), _holes(test)
    fitted = _fit(train, "logistic_regression")
    fills = prep.fit_imputation(train, ["balance"], ["segment"])
    served = scoring.batch_scores(fitted, test, SPEC).select(ID, F.col("score").alias("served"))
    filled = scoring.batch_scores(fitted, prep.impute(test, fills), SPEC).select(ID, F.col("score").alias("filled"))
    both = test.select(ID, "balance", "segment").join(served, ID).join(filled, ID)
    return both.agg(
        F.count("*").alias("n"),
        F.count("served").alias("scored"),
        F.count_if(F.abs(F.col("served") - F.col("filled")) < 1e-12).alias("like_filled"),
        F.count_if(F.col("balance").isNull() | F.col("segment").isNull()).alias("with_holes"),
    )


@query(
    "b6_key_drivers",
    with_split(
        """, f as (select 6 + count(distinct geography) - 1 + count(distinct segment) - 1 as n from split where split = 'train')
select model, cast(n as bigint) as features, cast(n * (n + 1) // 2 as bigint) as places, cast(n as bigint) as distinct_places
from f, (values ('decision_tree'), ('gradient_boosting'), ('random_forest')) m(model)"""
    ),
)
def key_drivers(spark, folder):
    """Each model ranks all features: its places are 1 to their number."""
    train, _ = _parts(spark, folder)
    importances = {}
    for kind in ("decision_tree", "random_forest", "gradient_boosting"):
        fitted = _fit(train, kind)
        importances[kind] = explain.feature_importance(fitted.learner, fitted.preparation.features)
    places = scoring.key_drivers(importances).unpivot("feature", list(importances), "model", "place")
    return places.groupBy("model").agg(
        F.count("feature").alias("features"), F.sum("place").alias("places"), F.countDistinct("place").alias("distinct_places")
    )


@query(
    "f3_segments",
    with_profile(
        "select cast(4 as bigint) as clusters, count(*) as n, cast(sum(exited) as bigint) as churned, "
        "count(*) as at_nearest_centre from profile"
    ),
)
def segments(spark, folder):
    """Cluster sizes and churners add up, and every customer belongs to the nearest centre."""
    rows = held_profile(spark, folder)
    clustered, table, centres = scoring.segments_with_centres(rows, SPEC, models.fit_preparation(rows, SPEC))
    far = [F.aggregate(
        F.zip_with(vector_to_array("features"), doubles(c), lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, b: a + b
    ) for c in centres]
    nearest = F.least(*far) >= F.element_at(F.array(*far), F.col("cluster") + 1) - 1e-9
    held = clustered.agg(F.count_if(nearest).alias("at_nearest_centre"))
    sums = table.agg(
        F.count("*").alias("clusters"),
        F.sum("n").alias("n"),
        F.sum(F.round(F.col("churn_rate") * F.col("n"))).cast("bigint").alias("churned"),
    )
    return sums.join(F.broadcast(held))


@query(
    "f3_segment_sizes",
    with_split("select count(*) as n, cast(4 as bigint) as clusters from split"),
)
def segment_sizes(spark, folder):
    """Every customer falls into one of the four segments."""
    rows = held_profile(spark, folder)
    clustered, _ = scoring.segments(rows, SPEC, models.fit_preparation(rows, SPEC))
    return clustered.agg(F.count("cluster").alias("n"), F.countDistinct("cluster").alias("clusters"))


