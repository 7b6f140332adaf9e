"""Registered queries: feature preparation, splits and samples."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from churnlake.operators import prep as ops
from churnlake.operators.split import stratified_folds, uniform_sample
from churnlake.plans.inputs import (
    ID,
    LABEL,
    SPEC,
    held_profile,
    linear_score,
    profile,
    rounded,
    scored,
    split_profile,
    with_profile,
    with_scored,
    with_split,
)
from churnlake.plans.registry import query

GEO = ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
SEG = ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
NUMBERS = ", ".join(SPEC.numeric)


def _flags(column: str, values) -> str:
    return ", ".join(
        f"cast(case when {column} = '{v}' then 1 else 0 end as int) as \"{column}_{v}\"" for v in values
    )


_CODED = f"{_flags('geography', GEO)}, {_flags('segment', SEG)}"


@query(
    "r1_drop_identifiers",
    with_profile(f"select customer_id, geography, segment, {NUMBERS}, exited from profile"),
)
def drop_identifiers(spark, folder):
    return ops.drop_identifiers(profile(spark, folder), SPEC)


@query("r2_one_hot", with_profile(f"select customer_id, {NUMBERS}, {_CODED}, exited from profile"))
def one_hot(spark, folder):
    rows = ops.drop_identifiers(held_profile(spark, folder), SPEC)
    return ops.one_hot(rows, ops.fit_levels(rows, SPEC.categorical))


@query(
    "r3_features_and_label",
    with_profile(f"select customer_id, {NUMBERS}, {_CODED}, exited as label from profile"),
)
def features_and_label(spark, folder):
    rows = held_profile(spark, folder)
    levels = ops.fit_levels(rows, SPEC.categorical)
    return ops.features_and_label(ops.one_hot(rows, levels), SPEC, ops.feature_names(SPEC, levels))


def _scaled(column: str) -> str:
    return f"round(({column} - m_{column}) / d_{column}, 6) + 0e0 as {column}"


@query(
    "r4_standardise",
    with_split(
        ", fit as (select "
        + ", ".join(
            f"avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as d_{c}" for c in SPEC.numeric
        )
        + " from split where split = 'train')\nselect customer_id, split, "
        + ", ".join(_scaled(c) for c in SPEC.numeric)
        + " from split, fit"
    ),
)
def standardise(spark, folder):
    rows = split_profile(spark, folder, *SPEC.numeric)
    scaling = ops.fit_scaling(rows.where(F.col("split") == "train"), SPEC.numeric)
    return rounded(ops.scale(rows, scaling).select(ID, "split", *SPEC.numeric))


@query(
    "r5_balance_salary_ratio",
    with_profile('select customer_id, round(balance / (est_spend + 1), 6) + 0e0 as "BalanceSalaryRatio" from profile'),
)
def balance_salary_ratio(spark, folder):
    return rounded(ops.add_derived(profile(spark, folder), SPEC).select(ID, "BalanceSalaryRatio"))


@query(
    "r6_product_density",
    with_profile(
        'select customer_id, round(cast(num_products as double) / (tenure + 1), 6) as "ProductDensity" from profile'
    ),
)
def product_density(spark, folder):
    return rounded(ops.add_derived(profile(spark, folder), SPEC).select(ID, "ProductDensity"))


@query(
    "r7_engagement_score",
    with_profile('select customer_id, is_active_member * num_products as "EngagementScore" from profile'),
)
def engagement_score(spark, folder):
    return ops.add_derived(profile(spark, folder), SPEC).select(ID, "EngagementScore")


@query("r8_interaction", with_profile('select customer_id, num_products * tenure as "AgeTenure" from profile'))
def interaction(spark, folder):
    return ops.add_derived(profile(spark, folder), SPEC).select(ID, "AgeTenure")


@query(
    "r9_imputation",
    with_split(
        """, holes as (
  select customer_id, split, case when balance < 0 then null else balance end as balance,
    case when segment = 'BUILDING' then null else segment end as segment from split),
fill as (
  select (select quantile_cont(balance, 0.5e0) from holes where split = 'train') as b,
    (select segment from holes where split = 'train' and segment is not null
       group by segment order by count(*) desc, segment limit 1) as s)
select customer_id, round(coalesce(balance, b), 6) as balance, coalesce(segment, s) as segment from holes, fill"""
    ),
)
def imputation(spark, folder):
    rows = split_profile(spark, folder, "balance", "segment")
    holes = rows.select(
        ID,
        "split",
        F.when(F.col("balance") >= 0, F.col("balance")).alias("balance"),
        F.when(F.col("segment") != "BUILDING", F.col("segment")).alias("segment"),
    )
    fills = ops.fit_imputation(holes.where(F.col("split") == "train"), ["balance"], ["segment"])
    return rounded(ops.impute(holes, fills).select(ID, "balance", "segment"))


@query(
    "r10_threshold",
    with_scored(
        "select customer_id, score, cast(score > 0.3e0 as int) as prediction from scored"
    ),
)
def threshold(spark, folder):
    rows = scored(spark, folder, "engagement")
    return rows.select(ID, "score", ops.apply_threshold(F.col("score"), 0.3).alias("prediction"))


@query(
    "r11_named_columns",
    with_profile(
        "select customer_id, "
        + ", ".join(f"cast({c} as double) as {c}" for c in SPEC.numeric)
        + " from profile"
    ),
)
def named_columns(spark, folder):
    assembled = VectorAssembler(inputCols=list(SPEC.numeric), outputCol="features").transform(profile(spark, folder))
    return ops.vector_to_columns(assembled, "features", SPEC.numeric, [ID])


@query(
    "r12_align",
    with_profile(
        "select customer_id, cast(est_spend as double) as est_spend, cast(0 as double) as geography_ATLANTIS, "
        "cast(case when segment = 'BUILDING' then 0 else balance end as double) as balance, "
        "cast(tenure as double) as tenure from profile"
    ),
)
def align(spark, folder):
    rows = profile(spark, folder).withColumn("balance", F.when(F.col("segment") != "BUILDING", F.col("balance")))
    return ops.align(rows, ["est_spend", "geography_ATLANTIS", "balance", "tenure"], [ID])


@query("x1_stratified_split", with_split("select customer_id, exited, split from split"))
def split_rows(spark, folder):
    return split_profile(spark, folder).select(ID, LABEL, "split")


@query(
    "x2_stratified_folds",
    with_profile(
        """select customer_id, exited,
  cast((row_number() over (partition by exited order by customer_id) - 1) * 5
    // count(*) over (partition by exited) as int) as fold from profile"""
    ),
)
def fold_rows(spark, folder):
    return stratified_folds(held_profile(spark, folder, ID, LABEL), LABEL, ID).select(ID, LABEL, "fold")


@query(
    "x3_uniform_sample",
    with_split(
        "select customer_id, exited, balance from split where split = 'test' order by k, customer_id limit 100"
    ),
)
def sample_rows(spark, folder):
    rows = split_profile(spark, folder, "balance")
    return uniform_sample(rows.where(F.col("split") == "test"), ID, 100, 42).select(ID, LABEL, "balance")


@query(
    "r_extended_scores",
    with_profile(
        """select customer_id, round(balance / (est_spend + 1), 6) + 0e0 as balance_ratio,
  round(cast(num_products as double) / (tenure + 1), 6) as density,
  cast(is_active_member * num_products as int) as engagement, cast(num_products * tenure as int) as product_tenure,
  round(1e0 / (1e0 + exp(-(0.21e0 + (-0.9e0) * is_active_member + (-0.15e0) * num_products + 0.00002e0 * balance))), 4) as score
from profile"""
    ),
)
def extended_scores(spark, folder):
    rows = ops.add_derived(profile(spark, folder), SPEC).withColumn("score", linear_score())
    return rows.select(
        ID,
        (F.round("BalanceSalaryRatio", 6) + F.lit(0.0)).alias("balance_ratio"),
        F.round("ProductDensity", 6).alias("density"),
        F.col("EngagementScore").alias("engagement"),
        F.col("AgeTenure").alias("product_tenure"),
        "score",
    )
