"""Explanations as tables: importances, linear Shapley values, their summaries, partial dependence."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.functions.expressions import doubles, quoted, ratio, to_rows
from churnlake.operators.selection import SMALL, exact_quantiles


def feature_importance(model, features: Sequence[str]) -> DataFrame:
    """Impurity importance of a fitted tree model per feature, largest first."""
    from pyspark.sql import SparkSession

    values = model.featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature")


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def importance_concentration(importances: DataFrame) -> DataFrame:
    """Share and cumulative share of each feature; the window runs over one row per feature."""
    falling = Window.orderBy(F.desc("importance"), "feature")
    upto = falling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.nullif(F.sum("importance").over(everything), F.lit(0.0))
    return importances.select(
        F.row_number().over(falling).alias("place"),
        "feature",
        "importance",
        ratio(F.col("importance"), total).alias("share"),
        ratio(F.sum("importance").over(upto), total).alias("cumulative_share"),
    )


def fit_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    row = df.agg(*[F.avg(F.col(c)).cast("double").alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(columns)}


def linear_shap(
    df: DataFrame, id_col: str, weights: Mapping[str, float], background: DataFrame | None = None
) -> DataFrame:
    """Exact Shapley values of a linear margin: weight times distance from the background mean."""
    means = fit_means(df if background is None else background, list(weights))
    rows = []
    for name, weight in weights.items():
        value = F.col(name).cast("double")
        rows.append(
            {
                "feature": F.lit(name),
                "feature_value": value,
                "shap_value": F.lit(float(weight)) * (value - F.lit(means[name])),
            }
        )
    return to_rows(df, rows, [id_col])


def shap_importance(shap: DataFrame) -> DataFrame:
    """Mean absolute Shapley value per feature."""
    return shap.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("importance"))


def beeswarm(shap: DataFrame, id_col: str) -> DataFrame:
    """Each contribution with its feature value scaled to 0..1 and the rank of its feature.

    Ranges and ranks are one row per feature, so joining them moves no explanation rows.
    """
    per_feature = shap.groupBy("feature").agg(
        F.avg(F.abs("shap_value")).alias("importance"),
        F.min("feature_value").alias("_lo"),
        F.max("feature_value").alias("_hi"),
    )
    place = F.row_number().over(Window.orderBy(F.desc(F.round("importance", 9)), "feature"))
    ranked = per_feature.withColumn("feature_rank", place)
    colour = ratio(F.col("feature_value") - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return shap.join(F.broadcast(ranked), "feature").select(
        id_col, "feature", "feature_rank", "shap_value", F.coalesce(colour, F.lit(0.5)).alias("scaled_value")
    )


def waterfall(shap: DataFrame, id_col: str, base_value: float, row_id) -> DataFrame:
    """Contributions of one row, smallest first, leading from the base value to f(x)."""
    mine = shap.where(F.col(id_col) == F.lit(row_id))
    rising = Window.partitionBy(id_col).orderBy(F.abs("shap_value"), "feature")
    upto = rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.lit(float(base_value)) + F.sum("shap_value").over(upto)
    return mine.select(
        id_col,
        F.row_number().over(rising).alias("step"),
        "feature",
        "feature_value",
        "shap_value",
        (after - F.col("shap_value")).alias("before"),
        after.alias("after"),
    )


def expected_value(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(F.avg(score).alias("expected_value"), F.count(score).alias("n"))


def dependence_grid(
    df: DataFrame, columns: Sequence[str], points: int = 100, low: float = 0.05, high: float = 0.95, small: int = SMALL
) -> dict[str, list[float]]:
    """The distinct values of a column when there are fewer than ``points``, else an even grid
    between two exact quantiles. One pass of sketches tells which columns surely hold more; only the
    others are reduced to their distinct values."""
    grids: dict[str, list[float]] = {}
    if not columns:
        return grids
    rough = df.agg(*[F.approx_count_distinct(F.col(quoted(c))).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    for i, c in enumerate(columns):
        if rough[i] > 2 * points:
            continue
        value = F.col(quoted(c)).cast("double")
        values = df.where(value.isNotNull()).select(value.alias("v")).distinct().limit(points).collect()
        if len(values) < points:
            grids[c] = sorted(r["v"] for r in values)
    wide = [c for c in columns if c not in grids]
    if wide:
        ends = exact_quantiles(df, {c: F.col(quoted(c)) for c in wide}, (low, high), small=small)
        for c in wide:
            start, stop = ends[(c, low)], ends[(c, high)]
            step = (stop - start) / (points - 1)
            grids[c] = [start + i * step for i in range(points)] if stop > start else [start]
    return {c: grids[c] for c in columns}


def partial_dependence(
    df: DataFrame, grids: Mapping[str, Sequence[float]], rescore: Callable[[DataFrame], DataFrame], score: str = "score"
) -> DataFrame:
    """Average score over all rows with one feature set to each grid value.

    Grid points multiply rows inside the scan stage only; partial averages leave one row per grid
    point and task for the shuffle.
    """
    grid = F.array(*[F.struct(F.lit(c).alias("feature"), doubles(values).alias("grid")) for c, values in grids.items()])
    names = list(df.columns)
    by_feature = df.select(*names, F.inline(grid).alias("_feature", "_grid"))
    spread = by_feature.select(*names, "_feature", F.explode("_grid").alias("_value"))
    swapped = spread.withColumns(
        {
            c: F.when(F.col("_feature") == c, F.col("_value")).otherwise(F.col(c).cast("double"))
            for c in grids
        }
    )
    return (
        rescore(swapped)
        .groupBy(F.col("_feature").alias("feature"), F.col("_value").alias("value"))
        .agg(F.avg(score).alias("average_score"))
    )


def score_column(expression: Column, name: str = "score") -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.withColumn(name, expression)
