"""Classification metrics from one pass of conditional counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.functions.expressions import ratio, ratio_or_zero, to_rows

THRESHOLDS = (0.5, 0.4, 0.3, 0.2)


def outcome_counts(df: DataFrame, by: Sequence[str] = (), label: str = "label", pred: str = "prediction") -> DataFrame:
    """True/false positives and negatives per group."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*by).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def threshold_counts(
    df: DataFrame,
    thresholds: Sequence[float] = THRESHOLDS,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
) -> DataFrame:
    """The four outcome counts at every threshold, one scan and one row per group in the shuffle."""
    y, s = F.col(label), F.col(score)
    known = s.isNotNull()
    sums = [F.count_if(known & (y == 1)).alias("pos"), F.count_if(known & (y == 0)).alias("neg")]
    for i, t in enumerate(thresholds):
        above = s > F.lit(float(t))
        sums += [F.count_if(above & (y == 1)).alias(f"tp{i}"), F.count_if(above & (y == 0)).alias(f"fp{i}")]
    rows = [
        {
            "threshold": F.lit(float(t)),
            "tp": F.col(f"tp{i}"),
            "fp": F.col(f"fp{i}"),
            "fn": F.col("pos") - F.col(f"tp{i}"),
            "tn": F.col("neg") - F.col(f"fp{i}"),
        }
        for i, t in enumerate(thresholds)
    ]
    return to_rows(df.groupBy(*by).agg(*sums), rows, by)


def accuracy() -> Column:
    return ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))


def precision() -> Column:
    return ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))


def f1() -> Column:
    return ratio_or_zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def specificity() -> Column:
    return ratio_or_zero(F.col("tn"), F.col("tn") + F.col("fp"))


def with_rates(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "accuracy": accuracy(),
            "precision": precision(),
            "recall": recall(),
            "f1": f1(),
            "specificity": specificity(),
        }
    )


def confusion_matrix(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All four cells as rows, empty ones included."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return to_rows(counts, [{"actual": F.lit(a), "predicted": F.lit(p), "n": F.col(c)} for a, p, c in cells], by)


def classification_report(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class, accuracy, macro and weighted rows from outcome counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n0, n1 = tn + fp, tp + fn
    total = n0 + n1
    class0 = (
        ratio_or_zero(tn, tn + fn),
        ratio_or_zero(tn, n0),
        ratio_or_zero(2 * tn, 2 * tn + fn + fp),
    )
    class1 = (precision(), recall(), f1())
    macro = [(a + b) / 2 for a, b in zip(class0, class1)]
    weighted = [ratio_or_zero(a * n0 + b * n1, total) for a, b in zip(class0, class1)]
    hit = ratio_or_zero(tp + tn, total)
    blank = F.lit(None).cast("double")
    lines = [
        ("0", *class0, n0),
        ("1", *class1, n1),
        ("accuracy", blank, blank, hit, total),
        ("macro avg", *macro, total),
        ("weighted avg", *weighted, total),
    ]
    rows = [
        {"class": F.lit(name), "precision": p, "recall": r, "f1": f, "support": s.cast("bigint")}
        for name, p, r, f, s in lines
    ]
    return to_rows(counts, rows, by)


def best_threshold(
    rates: DataFrame, by: Sequence[str] = (), recall_floor: float = 0.0, precision_floor: float = 0.0
) -> DataFrame:
    """The threshold with the highest F1 among those above both floors; ties go to the higher one."""
    allowed = rates.where((F.col("recall") >= recall_floor) & (F.col("precision") >= precision_floor))
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", "threshold")).alias("best")
    return allowed.groupBy(*by).agg(best).select(*by, "best.*")


def threshold_steps(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Change of recall and precision from each threshold to the next lower one.

    The window runs over one row per threshold and group, never over customers.
    """
    falling = Window.partitionBy(*by).orderBy(F.desc("threshold"))
    return rates.select(
        *by,
        "threshold",
        "recall",
        "precision",
        (F.col("recall") - F.lag("recall").over(falling)).alias("recall_change"),
        (F.col("precision") - F.lag("precision").over(falling)).alias("precision_change"),
    )


def compare_models(rates: DataFrame, areas: DataFrame, order_by: str = "accuracy") -> DataFrame:
    """One row per model with all metrics and its rank; both inputs hold one row per model."""
    ordered = Window.orderBy(F.desc(F.round(order_by, 9)), "model")
    return (
        rates.join(areas, "model")
        .select("model", "accuracy", "precision", "recall", "f1", "auc")
        .withColumn("place", F.row_number().over(ordered))
    )
