"""Feature preparation: encoding, scaling, derived features, imputation, schema alignment.

Everything fitted (levels, means, medians) is a fixed-size set of constants taken from one
aggregation; applying it is a narrow projection inside code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake.functions.expressions import flag, quoted, ratio
from churnlake.operators.profile import classes
from churnlake.operators.selection import SMALL, exact_quantiles
from churnlake.schema import CustomerTable


def drop_identifiers(df: DataFrame, spec: CustomerTable, keep_id: bool = True) -> DataFrame:
    gone = [c for c in spec.identifiers if not (keep_id and c == spec.id)]
    return df.drop(*gone)


def fit_levels(df: DataFrame, columns: Sequence[str], limit: int = 1000) -> dict[str, list[str]]:
    """Ascending levels of each categorical column; the first one is the dropped baseline. A column with
    more than ``limit`` levels is refused, as each level becomes a column."""
    return {c: classes(df, c, limit) for c in columns}


def dummy_name(column: str, level: str) -> str:
    """The level as it is: names that differ only in signs or script stay apart."""
    return f"{column}_{level}"


def dummies(levels: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    named = [(dummy_name(c, level), c, level) for c, values in levels.items() for level in values[1:]]
    if len({name for name, _, _ in named}) < len(named):
        raise ValueError("two levels would give columns of one name")
    return {name: flag(F.col(quoted(c)) == F.lit(level)) for name, c, level in named}


def one_hot(df: DataFrame, levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 columns after the untouched ones; a null or unseen value gets zeros everywhere."""
    coded = dummies(levels)
    return df.select(
        *[F.col(quoted(c)) for c in df.columns if c not in levels], *[expr.alias(name) for name, expr in coded.items()]
    )


def feature_names(spec: CustomerTable, levels: Mapping[str, Sequence[str]], feature_set: str = "base") -> list[str]:
    names = [*spec.numeric, *dummies(levels)]
    if feature_set == "extended":
        names += list(derived_features(spec))
    elif feature_set != "base":
        raise ValueError("feature_set is 'base' or 'extended'")
    return names


def features_and_label(df: DataFrame, spec: CustomerTable, features: Sequence[str]) -> DataFrame:
    label = F.col(quoted(spec.label)).cast("int").alias("label")
    return df.select(*[F.col(quoted(c)) for c in (spec.id, *features)], label)


def derived_features(spec: CustomerTable) -> dict[str, Column]:
    """The four engineered features. Without an age column, products take its place."""
    parts = (spec.balance, spec.salary, spec.products, spec.tenure, spec.active, spec.age or spec.products)
    balance, salary, products, tenure, active, elder = (F.col(quoted(c)) for c in parts)
    return {
        "BalanceSalaryRatio": ratio(balance, salary + 1),
        "ProductDensity": ratio(products, tenure + 1),
        "EngagementScore": active * products,
        "AgeTenure": elder * tenure,
    }


def add_derived(df: DataFrame, spec: CustomerTable) -> DataFrame:
    return df.withColumns(derived_features(spec))


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation per column; a zero deviation counts as 1."""

    mean: Mapping[str, float]
    deviation: Mapping[str, float]

    def expression(self, column: str) -> Column:
        return (F.col(column).cast("double") - F.lit(self.mean[column])) / F.lit(self.deviation[column])


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> Scaling:
    """Learn the scaling in one pass. Equal minimum and maximum mark a constant column, whose
    computed deviation may be rounding noise instead of zero."""
    row = df.agg(
        *[
            F.struct(
                F.avg(F.col(c)).cast("double").alias("mean"),
                F.stddev_pop(F.col(c).cast("double")).alias("deviation"),
                (F.min(F.col(c)) < F.max(F.col(c))).alias("varies"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    fitted = dict(zip(columns, row))
    return Scaling(
        {c: 0.0 if f["mean"] is None else f["mean"] for c, f in fitted.items()},
        {c: f["deviation"] if f["varies"] else 1.0 for c, f in fitted.items()},
    )


def scale(df: DataFrame, scaling: Scaling) -> DataFrame:
    return df.withColumns({c: scaling.expression(c) for c in scaling.mean})


def fit_imputation(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), small: int = SMALL
) -> dict[str, float | str | None]:
    """Exact median of numeric columns, most frequent value (ties: smallest) of categorical ones."""
    fills: dict[str, float | str | None] = {}
    medians = exact_quantiles(df, {c: F.col(quoted(c)) for c in numeric}, (0.5,), small=small) if numeric else {}
    for c in numeric:
        fills[c] = medians[(c, 0.5)]
    for c in categorical:
        values = df.select(F.col(quoted(c)).alias("v")).where("v IS NOT NULL")
        top = values.groupBy("v").count().orderBy(F.desc("count"), "v").first()
        fills[c] = top[0] if top else None
    return fills


def impute(df: DataFrame, fills: Mapping[str, float | str | None]) -> DataFrame:
    return df.withColumns(
        {
            c: F.coalesce(F.col(quoted(c)).cast("double") if isinstance(v, float) else F.col(quoted(c)), F.lit(v))
            for c, v in fills.items()
            if v is not None
        }
    )


def apply_threshold(score: Column, threshold: float) -> Column:
    """1 strictly above the threshold, 0 otherwise; a missing score has no class."""
    return (score > F.lit(threshold)).cast("int")


def vector_to_columns(df: DataFrame, vector: str, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    values = df.select(*keep, vector_to_array(F.col(vector)).alias("_v"))
    return values.select(*keep, *[F.col("_v")[i].alias(n) for i, n in enumerate(names)])


def align(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Match a training schema: add missing columns as 0, drop unknown ones, restore the order."""
    present = set(df.columns)
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(quoted(f)), F.lit(0)) if f in present else F.lit(0)).cast("double").alias(f)
            for f in features
        ],
    )
