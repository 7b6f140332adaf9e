"""Column expressions shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives NULL instead of failing on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def row_struct(fields: Mapping[str, Column]) -> Column:
    return F.struct(*[value.alias(name) for name, value in fields.items()])


def to_rows(df: DataFrame, rows: Iterable[Mapping[str, Column]], keep: Sequence[str] = ()) -> DataFrame:
    """Turn each input row into one output row per mapping (a generic unpivot)."""
    exploded = F.inline(F.array(*[row_struct(fields) for fields in rows]))
    return df.select(*keep, exploded)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating column, so null counts see both."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floating else F.col(c)
            for c in df.columns
        ]
    )


def sample_key(id_col: Column, seed: int) -> Column:
    """A 52-bit pseudo-random key of an id: the first 13 hex digits of md5('<id>:<seed>').

    52 bits are exact in a double, so quantile sketches of the key lose nothing.
    """
    digest = F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def order_key(df: DataFrame, id_col: str) -> Column:
    """What orders rows by id: a numeric id itself; any other id by a numeric hash, at every size, as
    order statistics are found among numbers."""
    ids = F.col(quoted(id_col))
    return ids if isinstance(df.select(ids).schema[0].dataType, T.NumericType) else sample_key(ids, 0)


def double_sql(value: float) -> str:
    """A double literal in SQL text. Wide expressions are built as text: one call to the JVM each."""
    value = float(value)
    if math.isfinite(value):
        return f"{value!r}D"
    return f"double('{value}')"


def literal_sql(value) -> str:
    """A numeric literal in SQL text."""
    if isinstance(value, float):
        return double_sql(value)
    if isinstance(value, int):
        return f"{value}L"
    return f"{value}BD"


def text_sql(value: str) -> str:
    """A string literal in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_sql(rows: Iterable[Mapping[str, str]]) -> Column:
    """One output row per mapping from name to SQL text: the unpivot of ``to_rows`` for wide tables."""
    structs = ("struct(" + ", ".join(f"{e} AS {quoted(n)}" for n, e in row.items()) + ")" for row in rows)
    return F.expr(f"inline(array({', '.join(structs)}))")


def doubles(values: Iterable[float]) -> Column:
    return F.expr(f"array({', '.join(double_sql(v) for v in values)})")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def linear_margin(weights: Mapping[str, float], intercept: float) -> Column:
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(name)
    return total
