"""ROC points, area under the curve and gain table, tie-aware and without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.functions.expressions import order_key, ratio
from churnlake.operators.ranking import descending_totals
from churnlake.operators.selection import SMALL, row_cuts


def score_steps(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score, with running totals from the highest score down, the totals of
    the group and the step that follows.

    Ties collapse before anything is ordered, so a score shared by a third of all rows is one row.
    """
    y = F.col(label)
    ties = (
        df.where(F.col(score).isNotNull() & y.isNotNull())
        .groupBy(*by, F.col(score).alias("threshold"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    return descending_totals(ties, by, "threshold", ["pos", "neg"])


def area_from_steps(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; NULL when a class is absent."""
    above = F.col("cum_pos").cast("double") - F.col("pos") / 2
    return steps.groupBy(*by).agg(
        ratio(
            F.sum(F.col("neg") * above),
            F.nullif(F.sum("pos").cast("double") * F.sum("neg").cast("double"), F.lit(0.0)),
        ).alias("auc")
    )


def roc_auc(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    return area_from_steps(score_steps(df, by, label, score), by)


def points_from_steps(steps: DataFrame, by: Sequence[str] = (), drop_collinear: bool = False) -> DataFrame:
    """ROC points per distinct score, plus the origin (threshold NULL), which the first step brings along.

    ``drop_collinear`` drops points whose step up the curve equals the following step; the first and last one stay.
    """
    first = "cum_pos = pos AND cum_neg = neg"
    if drop_collinear:
        steps = steps.where(f"following IS NULL OR {first} OR following <> struct(pos, neg)")
    point = (
        "struct(CAST(threshold AS double) AS threshold, cum_neg AS fp, cum_pos AS tp,"
        " cum_neg / nullif(CAST(all_neg AS double), 0D) AS fpr, cum_pos / nullif(CAST(all_pos AS double), 0D) AS tpr)"
    )
    origin = "struct(CAST(NULL AS double) AS threshold, 0L AS fp, 0L AS tp, 0D AS fpr, 0D AS tpr)"
    return steps.select(*by, F.expr(f"inline(IF({first}, array({origin}, {point}), array({point})))"))


def roc_points(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
    drop_collinear: bool = False,
) -> DataFrame:
    return points_from_steps(score_steps(df, by, label, score), by, drop_collinear)


def roc_with_diagonal(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC points and area per model, with the two ends of the chance line as model 'random'."""
    steps = score_steps(df, ["model"], label, score)
    curves = points_from_steps(steps, ["model"]).join(area_from_steps(steps, ["model"]), "model")
    diagonal = df.sparkSession.createDataFrame(
        [("random", None, None, None, e, e, 0.5) for e in (0.0, 1.0)],
        "model string, threshold double, fp long, tp long, fpr double, tpr double, auc double",
    )
    return curves.unionByName(diagonal)


def gain_table(
    df: DataFrame,
    id_col: str,
    label: str = "label",
    score: str = "score",
    tiles: int = 10,
    small: int = SMALL,
) -> DataFrame:
    """Churn share, lift and cumulative gain per score decile (1 = highest scores, ties by id;
    ids that are no numbers in the order of a hash).

    Decile borders are exact order statistics; each row then falls into its decile by comparison,
    and only per-decile sums are shuffled.
    """
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    total, churned = known.agg(F.count("*"), F.sum(F.col(label)).cast("bigint")).first()
    churned = churned or 0
    falling, ids = -F.col(score), order_key(df, id_col)
    size, extra = divmod(total, tiles)
    starts = [j * size + min(j, extra) for j in range(1, tiles)]
    starts = [s for s in starts if s < total]
    cuts = row_cuts(known, {"score": falling}, ids, {"score": starts}, {"score": total}, small)
    tile = F.lit(1)
    for s in starts:
        tile = tile + F.when(cuts[("score", s)].at_or_after(falling, ids), 1).otherwise(0)
    sums = known.groupBy(tile.cast("int").alias("decile")).agg(
        F.count("*").alias("n"), F.sum(F.col(label)).cast("bigint").alias("churned")
    )
    upto = Window.orderBy("decile").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rate = ratio(F.col("churned"), F.col("n"))
    return sums.select(
        "decile",
        "n",
        "churned",
        rate.alias("churn_rate"),
        ratio(rate, F.nullif(F.lit(churned / total if total else 0.0), F.lit(0.0))).alias("lift"),
        ratio(F.sum("churned").over(upto), F.nullif(F.lit(churned), F.lit(0))).alias("cumulative_gain"),
    )
