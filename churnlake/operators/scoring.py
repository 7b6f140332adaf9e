"""From scores to decisions: risk bands, lists, scenarios, retention targets, drivers, segments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.functions.expressions import quoted, ratio
from churnlake.operators.models import Fitted, Preparation
from churnlake.schema import CustomerTable

MEDIUM_RISK = 0.30
HIGH_RISK = 0.40


def align_customers(df: DataFrame, spec: CustomerTable) -> DataFrame:
    """Give new records the training columns: an absent number column counts as 0, an absent category
    as unseen, and unknown columns are dropped. Missing values in a column that is there stay missing; the
    fitted preparation fills them as it did in training."""
    present = set(df.columns)
    numbers = [(F.col(quoted(c)) if c in present else F.lit(0)).alias(c) for c in spec.numeric]
    texts = [(F.col(quoted(c)) if c in present else F.lit("")).cast("string").alias(c) for c in spec.categorical]
    return df.select(F.col(quoted(spec.id)), *numbers, *texts)


def batch_scores(fitted: Fitted, df: DataFrame, spec: CustomerTable) -> DataFrame:
    return fitted.score(align_customers(df, spec)).select(F.col(quoted(spec.id)), "score", "prediction")


def risk_band(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score < MEDIUM_RISK, "low").when(score < HIGH_RISK, "medium").otherwise("high")


def risk_scores(df: DataFrame, id_col: str, score: str = "score") -> DataFrame:
    value = F.col(score)
    return df.select(id_col, score, F.round(value * 100).cast("int").alias("risk_score"), risk_band(value).alias("band"))


def high_risk_list(df: DataFrame, id_col: str, k: int = 100, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), id_col).limit(k)


def high_risk_per_group(df: DataFrame, group: str, id_col: str, k: int = 10, score: str = "score") -> DataFrame:
    """The ``k`` highest scores of each group. Spark keeps only ``k`` rows per group and task before
    the shuffle, so a group with a third of all customers is no bottleneck."""
    falling = Window.partitionBy(group).orderBy(F.desc(score), id_col)
    return df.withColumn("place", F.row_number().over(falling)).where(F.col("place") <= k)


def scenario_scores(
    df: DataFrame,
    scenarios: Mapping[str, Mapping[str, float | str]],
    rescore: Callable[[DataFrame], DataFrame],
    id_col: str,
    score: str = "score",
) -> DataFrame:
    """Score each row as it is and under each scenario's overrides; row-local, no shuffle."""
    columns = list(df.columns)
    touched = sorted({c for overrides in scenarios.values() for c in overrides})
    kinds = {f.name: f.dataType for f in df.schema.fields}
    table = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                *[F.lit(overrides.get(c)).cast(kinds[c]).alias(f"_new_{c}") for c in touched],
            )
            for name, overrides in scenarios.items()
        ]
    )
    base = rescore(df).select(*columns, F.col(score).alias("base_score"))
    spread = base.select(*columns, "base_score", F.inline(table))
    changed = spread.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in touched})
    scored = rescore(changed.drop(*[f"_new_{c}" for c in touched]))
    return scored.select(id_col, "scenario", "base_score", score, (F.col(score) - F.col("base_score")).alias("change"))


def scenario_summary(scored: DataFrame, score: str = "score", threshold: float = HIGH_RISK) -> DataFrame:
    return scored.groupBy("scenario").agg(
        F.count("*").alias("n"),
        F.avg("base_score").alias("mean_base"),
        F.avg(score).alias("mean_score"),
        F.avg("change").alias("mean_change"),
        F.count_if(F.col("base_score") > threshold).alias("high_before"),
        F.count_if(F.col(score) > threshold).alias("high_after"),
    )


def retention_targets(
    scored: DataFrame,
    id_col: str,
    active: str,
    k: int,
    score: str = "score",
    threshold: float = HIGH_RISK,
    segment: DataFrame | None = None,
    contacted: DataFrame | None = None,
) -> DataFrame:
    """Inactive, high-risk customers in the target segment not contacted yet, highest score first.

    Both id lists are made distinct before they are joined, so a customer contacted a billion times
    adds one key.
    """
    picked = scored.where((F.col(active) == 0) & (F.col(score) > threshold))
    if segment is not None:
        picked = picked.join(segment.select(id_col).distinct(), id_col, "left_semi")
    if contacted is not None:
        picked = picked.join(contacted.select(id_col).distinct(), id_col, "left_anti")
    return picked.orderBy(F.desc(score), id_col).limit(k)


def key_drivers(importances: Mapping[str, DataFrame]) -> DataFrame:
    """Importance rank of each feature per model, side by side (one row per feature)."""
    table = None
    for model, values in importances.items():
        place = F.row_number().over(Window.orderBy(F.desc("importance"), "feature"))
        part = values.select(F.lit(model).alias("model"), "feature", place.alias("place"))
        table = part if table is None else table.unionByName(part)
    return table.groupBy("feature").pivot("model", list(importances)).agg(F.first("place"))


def segments_with_centres(
    df: DataFrame, spec: CustomerTable, preparation: Preparation, k: int = 4, seed: int = 42
) -> tuple[DataFrame, DataFrame, list[list[float]]]:
    """K-means clusters on the prepared features: rows with features and cluster, profile per cluster, centres.

    Rows are laid out by id before the fit, so the same table gives the same clusters.
    """
    means = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster")
    laid_out = df.repartitionByRange(F.col(quoted(spec.id))).sortWithinPartitions(F.col(quoted(spec.id)))
    fitted = Pipeline(stages=[*preparation.stages(), means]).fit(laid_out)
    clustered = fitted.transform(df)
    profile = clustered.groupBy("cluster").agg(
        F.count("*").alias("n"),
        ratio(F.sum(F.col(spec.label)), F.count(F.col(spec.label))).alias("churn_rate"),
        *[F.avg(F.col(quoted(c))).alias(f"mean_{c}") for c in spec.numeric],
    )
    centres = [c.tolist() for c in fitted.stages[-1].clusterCenters()]
    return clustered.select(spec.id, "features", "cluster"), profile, centres


def segments(
    df: DataFrame, spec: CustomerTable, preparation: Preparation, k: int = 4, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(rows with their cluster, profile per cluster)."""
    clustered, profile, _ = segments_with_centres(df, spec, preparation, k, seed)
    return clustered.select(spec.id, "cluster"), profile
