"""Stratified split, folds and samples that are exact, repeatable and free of row shuffles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.functions.expressions import order_key, sample_key
from churnlake.operators.selection import SMALL, row_cuts


def class_counts(df: DataFrame, label: str, limit: int = 1000) -> dict:
    rows = df.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(label).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{label} has more than {limit} classes")
    return {r[0]: r[1] for r in rows}


def test_counts(counts: dict, test_share: float) -> dict:
    """Test rows per class: the rounded-up total, allotted by largest remainder."""
    total = sum(counts.values())
    wanted = math.ceil(round(test_share * total, 6))
    allotted = {c: n * wanted // total for c, n in counts.items()}
    order = sorted(counts, key=lambda c: (-(counts[c] * wanted % total), c))
    for c in order[: wanted - sum(allotted.values())]:
        allotted[c] += 1
    return allotted


def stratified_split(
    df: DataFrame,
    label: str,
    id_col: str,
    test_share: float = 0.2,
    seed: int = 42,
    small: int = SMALL,
    class_limit: int = 1000,
) -> DataFrame:
    """Add ``split`` ('test'/'train') with exact class counts.

    Within a class the rows with the smallest (hash key, id) form the test part. Only the cutting
    row of each class is looked up; every row is then decided by comparing with constants. A label with
    more than ``class_limit`` values is refused.
    """
    counts = class_counts(df, label, class_limit)
    if not counts:
        return df.withColumn("split", F.lit("train"))
    test = test_counts(counts, test_share)
    key = sample_key(F.col(id_col), seed)
    series = {str(c): F.when(F.col(label) == F.lit(c), key) for c in counts}
    ranks = {str(c): [test[c]] for c in counts if test[c] < counts[c]}
    ids = order_key(df, id_col)
    cuts = row_cuts(df, series, ids, ranks, {str(c): n for c, n in counts.items()}, small)
    train = F.lit(False)
    for c in counts:
        if test[c] < counts[c]:
            train = train | ((F.col(label) == F.lit(c)) & cuts[(str(c), test[c])].at_or_after(key, ids))
    return df.withColumn("split", F.when(train | F.col(label).isNull(), "train").otherwise("test"))


def stratified_folds(
    df: DataFrame, label: str, id_col: str, folds: int = 5, small: int = SMALL, class_limit: int = 1000
) -> DataFrame:
    """Add ``fold``: contiguous chunks of each class in id order (ids that are no numbers: in the order
    of a hash). A label with more than ``class_limit``
    values is refused."""
    counts = class_counts(df, label, class_limit)
    ids = order_key(df, id_col)
    series = {str(c): F.when(F.col(label) == F.lit(c), ids) for c in counts}
    starts = {c: sorted({s for j in range(1, folds) if (s := -(-j * n // folds)) < n}) for c, n in counts.items()}
    cuts = row_cuts(
        df, series, ids, {str(c): s for c, s in starts.items()}, {str(c): n for c, n in counts.items()}, small
    )
    fold: Column = F.lit(None).cast("int")
    for c, n in counts.items():
        number = F.lit(0)
        for j in range(1, folds):
            start = -(-j * n // folds)
            if start < n:
                number = number + F.when(cuts[(str(c), start)].at_or_after(ids, ids), 1).otherwise(0)
        fold = F.when(F.col(label) == F.lit(c), number).otherwise(fold)
    return df.withColumn("fold", fold)


def uniform_sample(df: DataFrame, id_col: str, n: int = 100, seed: int = 42) -> DataFrame:
    """``n`` rows with the smallest hash keys: a distributed top-k, the same rows on every run."""
    return df.orderBy(sample_key(F.col(id_col), seed), F.col(id_col)).limit(n)
