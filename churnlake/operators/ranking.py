"""Running totals from the highest value down, without a single-task window.

The table is written once and cut into slices of some ``SLICE_ROWS`` rows by borders that a sketch proposes; a row's
slice is a comparison with constants. Each slice has a summary: its totals and its first row. Summaries are few, and
put together in order they carry to each slice what stands before it, the first row after it and the totals of
all. The window then runs inside slices only, over one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.functions.expressions import double_sql, quoted
from churnlake.session import staged

#: Rows of a slice, and the number of slices beyond which slices grow.
SLICE_ROWS, MOST_SLICES = 500_000, 1024


def slice_borders(df: DataFrame, order: str, slice_rows: int = SLICE_ROWS) -> list[float]:
    """Ascending values between slices of about ``slice_rows`` rows."""
    slices = min(MOST_SLICES, -(-df.count() // slice_rows))
    if slices < 2:
        return []
    shares = ", ".join(f"{i / slices!r}D" for i in range(1, slices))
    found = df.selectExpr(f"percentile_approx(CAST({quoted(order)} AS double), array({shares}), {max(10_000, 10 * slices)})").first()[0]
    return sorted(set(found or []))


def slice_number(order: str, borders: Sequence[float]) -> str:
    """How many borders lie above the value, as a tree of comparisons: 0 for the slice of the highest values."""

    def among(least: int, most: int) -> str:
        if least == most:
            return str(len(borders) - least)
        middle = (least + most + 1) // 2
        return f"IF({quoted(order)} >= {double_sql(borders[middle - 1])}, {among(middle, most)}, {among(least, middle - 1)})"

    return among(0, len(borders))


def descending_totals(df: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add to each row, by falling ``order`` within each group: ``cum_<column>``, the running sum up to and with the row,
    ``all_<column>``, the sum over the group, and ``following``, the columns of the next row as a struct, null at the end.

    The order must be numeric and unique within a group.
    """
    whole = staged(df, "ranked")
    sliced = whole.withColumn("_slice", F.expr(slice_number(order, slice_borders(whole, order, slice_rows))))
    row = F.struct(*[F.col(quoted(c)) for c in sums])
    summary = sliced.groupBy(*by, "_slice").agg(
        *[F.sum(quoted(c)).alias(f"_t_{c}") for c in sums], F.max_by(row, F.col(quoted(order))).alias("_first")
    )
    group = Window.partitionBy(*by)
    downward = group.orderBy("_slice")
    before = downward.rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums],
        *[F.sum(f"_t_{c}").over(group).alias(f"all_{c}") for c in sums],
        F.lead("_first").over(downward).alias("_next"),
    )
    inside = Window.partitionBy(*by, "_slice").orderBy(F.desc(quoted(order)))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = sliced.select(
        *by,
        "_slice",
        *[F.col(quoted(c)) for c in df.columns if c not in by],
        *[F.sum(quoted(c)).over(upto).alias(f"_c_{c}") for c in sums],
        F.lead(row).over(inside).alias("_row"),
    )
    return within.join(carried, [*by, "_slice"]).select(
        *df.columns,
        *[(F.col(f"_c_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums],
        *[f"all_{c}" for c in sums],
        F.coalesce("_row", "_next").alias("following"),
    )
