"""Registered queries: Shapley values, their summaries, partial dependence, importances."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlake.operators import explain
from churnlake.operators import forest_shap as forest
from churnlake.operators.models import fit_model, with_score
from churnlake.operators.prep import align
from churnlake.plans.inputs import (
    ENGAGEMENT_MARGIN,
    ID,
    SPEC,
    held_profile,
    linear_score,
    profile,
    rounded,
    whole_split,
    with_profile,
    with_scored,
    with_split,
)
from churnlake.plans.inputs import ENGAGEMENT
from churnlake.plans.registry import query
from churnlake.session import staged

WEIGHTS, INTERCEPT = ENGAGEMENT

_SHAP = """means as (select avg(is_active_member) a, avg(num_products) p, avg(balance) b from profile),
shap as (
  select customer_id, 'is_active_member' as feature, cast(is_active_member as double) as feature_value,
    (-0.9e0) * (is_active_member - a) as shap_value from profile, means
  union all
  select customer_id, 'num_products', cast(num_products as double), (-0.15e0) * (num_products - p) from profile, means
  union all
  select customer_id, 'balance', balance, 0.00002e0 * (balance - b) from profile, means)"""


def _linear(spark, folder):
    return explain.linear_shap(held_profile(spark, folder, ID, *WEIGHTS), ID, WEIGHTS)


def _with_shap(body: str) -> str:
    return with_profile(f", {_SHAP}\n{body}")


@query(
    "i12_linear_shap",
    _with_shap("select customer_id, feature, feature_value, round(shap_value, 6) + 0e0 as shap_value from shap"),
)
def linear_shap(spark, folder):
    return rounded(_linear(spark, folder), 6, "shap_value")


@query(
    "i5_shap_importance",
    _with_shap("select feature, round(avg(abs(shap_value)), 6) as importance from shap group by feature"),
)
def shap_importance(spark, folder):
    return rounded(explain.shap_importance(_linear(spark, folder)))


@query(
    "i6_impact_strip",
    _with_shap("select customer_id, feature, round(shap_value, 6) + 0e0 as shap_value from shap"),
)
def impact_strip(spark, folder):
    return rounded(_linear(spark, folder).select(ID, "feature", "shap_value"))


@query(
    "i7_beeswarm",
    _with_shap(
        """, f as (
  select feature, avg(abs(shap_value)) i, min(feature_value) lo, max(feature_value) hi from shap group by feature),
ranked as (select *, cast(row_number() over (order by round(i, 9) desc, feature) as int) feature_rank from f)
select customer_id, feature, feature_rank, round(shap_value, 6) + 0e0 as shap_value,
  round(coalesce((feature_value - lo) / nullif(hi - lo, 0), 0.5e0), 6) as scaled_value
from shap join ranked using (feature)"""
    ),
)
def beeswarm(spark, folder):
    return rounded(explain.beeswarm(_linear(spark, folder), ID))


@query(
    "i8_waterfall",
    _with_shap(
        f""", base as (select avg({ENGAGEMENT_MARGIN}) b from profile),
one as (select min(customer_id) c from profile),
steps as (
  select customer_id, feature, feature_value, shap_value, row_number() over w step, b + sum(shap_value) over w as after
  from shap, base, one where customer_id = c window w as (order by abs(shap_value), feature rows unbounded preceding))
select customer_id, cast(step as int) as step, feature, feature_value, round(shap_value, 6) + 0e0 as shap_value,
  round(after - shap_value, 6) + 0e0 as "before", round(after, 6) + 0e0 as "after" from steps"""
    ),
)
def waterfall(spark, folder):
    from churnlake.functions.expressions import linear_margin

    rows = held_profile(spark, folder, ID, *WEIGHTS)
    base, first_id = rows.agg(F.avg(linear_margin(WEIGHTS, INTERCEPT)), F.min(ID)).first()
    shap = explain.linear_shap(rows, ID, WEIGHTS)
    return rounded(explain.waterfall(shap, ID, base, first_id), 6, "shap_value", "before", "after")


@query("i9_expected_value", with_scored("select round(avg(score), 6) as expected_value, count(score) as n from scored"))
def expected_value(spark, folder):
    return rounded(explain.expected_value(profile(spark, folder).withColumn("score", linear_score())))


def _grid_sql(column: str) -> str:
    return f"""{column}_d as (select distinct cast({column} as double) v from profile),
{column}_e as (
  select quantile_cont(cast({column} as double), 0.05e0) lo, quantile_cont(cast({column} as double), 0.95e0) hi from profile),
{column}_g as (
  select '{column}' as feature, v from {column}_d where (select count(*) from {column}_d) < 100
  union all
  select '{column}', lo + i * ((hi - lo) / 99) from {column}_e, range(100) t(i)
  where (select count(*) from {column}_d) >= 100)"""


def _dependence(column: str) -> str:
    margin = ENGAGEMENT_MARGIN.replace(column, "v")
    return (
        f"select feature, round(v, 4) as value, round(avg(round(1e0 / (1e0 + exp(-{margin})), 4)), 6) as average_score "
        f"from profile, {column}_g group by feature, v"
    )


_DEPENDENT = ("balance", "num_products", "is_active_member")


@query(
    "i10_partial_dependence",
    with_profile(
        ", "
        + ",\n".join(_grid_sql(c) for c in _DEPENDENT)
        + "\n"
        + "\nunion all\n".join(_dependence(c) for c in _DEPENDENT)
    ),
)
def partial_dependence(spark, folder):
    rows = held_profile(spark, folder, *_DEPENDENT)
    grids = explain.dependence_grid(rows, _DEPENDENT)
    table = explain.partial_dependence(rows, grids, explain.score_column(linear_score()))
    return rounded(rounded(table, 4, "value"), 6, "average_score")


@query(
    "i11_importance_concentration",
    _with_shap(
        """, f as (select feature, avg(abs(shap_value)) i from shap group by feature)
select cast(row_number() over w as int) as place, feature, round(i, 6) as importance,
  round(i / sum(i) over (), 6) as share, round(sum(i) over w / sum(i) over (), 6) as cumulative_share
from f window w as (order by i desc, feature rows unbounded preceding)"""
    ),
)
def importance_concentration(spark, folder):
    return rounded(explain.importance_concentration(explain.shap_importance(_linear(spark, folder))))


# A fixed ensemble of two trees: products and activity interact in the first, balance alone decides
# the second. Values are the shares each leaf adds to the score.
FIXED_FEATURES = ("num_products", "is_active_member", "balance")
FIXED_LEAVES = (
    forest.Leaf(0, 0.30, {}, {0: 3.5, 1: 0.5}),
    forest.Leaf(0, 0.15, {1: 0.5}, {0: 3.5}),
    forest.Leaf(0, 0.05, {0: 3.5}, {}),
    forest.Leaf(1, 0.10, {}, {2: 4500.0}),
    forest.Leaf(1, 0.25, {2: 4500.0}, {}),
)

_FIXED = """flags as (
  select customer_id, num_products, is_active_member, coalesce(balance, 0) as balance, cast(num_products <= 3.5e0 as int) p,
    cast(is_active_member <= 0.5e0 as int) a, cast(coalesce(balance, 0) > 4500e0 as int) b from profile),
e as (
  select avg(p) ep, avg(a) ea, avg(b) eb, avg(p * a) epa, avg(p * (1 - a)) epn from flags),
parts as (
  select f.*, e.*,
    p * (0.15e0 + 0.15e0 * a) + 0.05e0 * (1 - p) as t_own,
    p * (0.15e0 + 0.15e0 * ea) + 0.05e0 * (1 - p) as t_p,
    ep * (0.15e0 + 0.15e0 * a) + 0.05e0 * (1 - ep) as t_a,
    0.15e0 * ep + 0.15e0 * epa + 0.05e0 * (1 - ep) as t_none from flags f, e)"""


@query(
    "i3_forest_shap_fixed",
    with_profile(
        f""", {_FIXED}
select customer_id, 'num_products' as feature, cast(num_products as double) as feature_value,
  round(((t_p - t_none) + (t_own - t_a)) / 2, 6) + 0e0 as shap_value from parts
union all
select customer_id, 'is_active_member', cast(is_active_member as double),
  round(((t_a - t_none) + (t_own - t_p)) / 2, 6) + 0e0 from parts
union all
select customer_id, 'balance', balance, round(0.15e0 * (b - eb), 6) + 0e0 from parts"""
    ),
)
def forest_shap_fixed(spark, folder):
    """Shapley values of a fixed two-tree ensemble: every customer against all customers."""
    rows = align(held_profile(spark, folder, ID, *FIXED_FEATURES), FIXED_FEATURES, [ID])
    return rounded(forest.forest_shap(rows, rows, FIXED_LEAVES, ID, FIXED_FEATURES), 6, "shap_value")


@query(
    "i3_forest_base_value",
    with_profile(
        f", {_FIXED}\nselect round(avg(t_own + 0.10e0 + 0.15e0 * b), 6) as base_value, count(*) as n from parts"
    ),
)
def forest_base_value(spark, folder):
    rows = align(held_profile(spark, folder, ID, *FIXED_FEATURES), FIXED_FEATURES, [ID])
    outputs = forest.forest_output(rows, FIXED_LEAVES, ID, FIXED_FEATURES)
    return rounded(outputs.agg(F.avg("output").alias("base_value"), F.count("*").alias("n")))


@query(
    "i10_forest_dependence_fixed",
    with_profile(
        f""", {_FIXED}, g as (select distinct cast(num_products as double) v from profile)
select 'num_products' as feature, v as value,
  round(avg(case when v <= 3.5e0 then 0.15e0 + 0.15e0 * a else 0.05e0 end + 0.10e0 + 0.15e0 * b), 6) as average_score
from parts, g group by v
union all
select 'balance', v, round(avg(t_own + case when v > 4500e0 then 0.25e0 else 0.10e0 end), 6)
from parts, (values (0e0), (4000e0), (4500e0), (5000e0), (9000e0)) t(v) group by v"""
    ),
)
def forest_dependence_fixed(spark, folder):
    rows = align(held_profile(spark, folder, *FIXED_FEATURES), FIXED_FEATURES)
    grids = explain.dependence_grid(rows, ["num_products"], points=100)
    grids["balance"] = [0.0, 4000.0, 4500.0, 5000.0, 9000.0]
    return rounded(forest.forest_partial_dependence(rows, FIXED_LEAVES, FIXED_FEATURES, grids))


def _fitted_forest(spark, folder):
    rows = whole_split(spark, folder)
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    return fit_model(train, SPEC, "random_forest"), train, test


_N_FEATURES = """, f as (
  select cast(6 + count(distinct geography) - 1 + count(distinct segment) - 1 as bigint) as n from split where split = 'train')
"""


@query(
    "i1_feature_importance",
    with_split(_N_FEATURES + "select n as features, cast(0 as bigint) as negative, 1e0 as total from f"),
)
def feature_importance(spark, folder):
    """Importances of all features: none negative, and 1 in total."""
    fitted, _, _ = _fitted_forest(spark, folder)
    table = explain.feature_importance(fitted.learner, fitted.preparation.features)
    return table.agg(
        F.countDistinct("feature").alias("features"),
        F.count_if(F.col("importance") < 0).alias("negative"),
        F.round(F.sum("importance"), 6).alias("total"),
    )


@query(
    "i2_top_features",
    with_split(_N_FEATURES + "select least(n, 10) as features, least(n, 10) as outrank_all_others from f"),
)
def top_features(spark, folder):
    """The ten features in the list are at least as important as any that is not in it."""
    fitted, _, _ = _fitted_forest(spark, folder)
    table = explain.feature_importance(fitted.learner, fitted.preparation.features)
    top = explain.top_features(table, 10).select("feature", "importance")
    others = table.join(top.select("feature"), "feature", "left_anti").agg(F.coalesce(F.max("importance"), F.lit(0.0)).alias("most"))
    return top.join(F.broadcast(others)).agg(
        F.countDistinct("feature").alias("features"), F.count_if(F.col("importance") >= F.col("most")).alias("outrank_all_others")
    )


def _shap_of_test(spark, folder):
    """Every test customer explained against all training customers."""
    fitted, train, test = _fitted_forest(spark, folder)
    leaves = forest.leaf_table(spark, fitted.learner)
    explained, background = (staged(forest.feature_rows(fitted, part, ID), "inputs") for part in (test, train))
    names = fitted.preparation.features
    return fitted, test, explained, background, leaves, forest.forest_shap(explained, background, leaves, ID, names)


@query(
    "i3_forest_shap",
    with_split(
        _N_FEATURES
        + """, t as (select count(*) as rows from split where split = 'test')
select rows * n as n_values, rows as customers, n as features from t, f"""
    ),
)
def forest_shap(spark, folder):
    """One contribution for each test customer and feature."""
    *_, shap = _shap_of_test(spark, folder)
    known = shap.where(F.col("shap_value").isNotNull() & ~F.isnan("shap_value"))
    return known.groupBy(ID).agg(F.count("*").alias("k"), F.collect_set("feature").alias("s")).agg(
        F.sum("k").alias("n_values"), F.count("*").alias("customers"), F.max(F.size("s")).cast("bigint").alias("features")
    )


@query(
    "i3_forest_shap_additivity",
    with_split("select count(*) as n, cast(0 as bigint) as broken from split where split = 'test'"),
)
def forest_shap_additivity(spark, folder):
    """Base value plus contributions give the fitted forest's probability for each test customer."""
    fitted, test, _, background, leaves, shap = _shap_of_test(spark, folder)
    base = forest.forest_base_value(background, leaves, fitted.preparation.features)
    sums = shap.groupBy(ID).agg(F.sum("shap_value").alias("s"))
    gap = F.abs(F.col("s") + F.lit(base) - F.col("score"))
    return sums.join(fitted.score(test).select(ID, "score"), ID).agg(
        F.count("*").alias("n"), F.count_if(gap > 1e-9).alias("broken")
    )


@query(
    "i10_model_dependence",
    with_split(
        """, d as (
  select count(distinct balance) a, count(distinct num_products) b, count(distinct est_spend) c from split where split = 'test')
select cast(least(a, 100) + least(b, 100) + least(c, 100) as bigint) as points,
  cast(least(a, 100) + least(b, 100) + least(c, 100) as bigint) as same from d"""
    ),
)
def model_dependence(spark, folder):
    """Partial dependence of a fitted forest on three features, over all test customers: the counted form
    equals scoring every row with every value."""
    fitted, _, test = _fitted_forest(spark, folder)
    features = ["balance", "num_products", "est_spend"]
    leaves = forest.leaf_table(spark, fitted.learner)
    rows = staged(forest.feature_rows(fitted, test, ID), "inputs")
    names = fitted.preparation.features
    grids = explain.dependence_grid(rows, features)
    counted = forest.forest_partial_dependence(rows, leaves, names, grids)
    again = VectorAssembler(inputCols=list(names), outputCol="features")
    brute = explain.partial_dependence(
        rows.select(*names), grids, lambda df: with_score(fitted.learner.transform(again.transform(df)))
    )
    place = F.dense_rank().over(Window.partitionBy("feature").orderBy("value"))  # at most 100 rows each
    left = counted.select("feature", place.alias("place"), F.col("average_score").alias("x"))
    right = brute.select("feature", place.alias("place"), F.col("average_score").alias("y"))
    return left.join(right, ["feature", "place"], "full").agg(
        F.count("*").alias("points"), F.count_if(F.abs(F.col("x") - F.col("y")) < 1e-9).alias("same")
    )
