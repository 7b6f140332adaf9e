"""Profiling: what is in a customer table, and where churn differs from the base rate."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.functions.expressions import double_sql, flag, inline_sql, quoted, ratio, text_sql, to_rows
from churnlake.operators.selection import SMALL, exact_quantiles

LIFT_FLOOR = 1.25
Z_FLOOR = 1.645
#: A published polynomial for the tail of the normal distribution.
TAIL_POLYNOMIAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def column_info(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of every column, in one pass."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)])
    return to_rows(
        counts,
        [
            {
                "column": F.lit(f.name),
                "dtype": F.lit(f.dataType.simpleString()),
                "non_null": F.col(f"c{i}"),
            }
            for i, f in enumerate(fields)
        ],
    )


def null_counts(df: DataFrame) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return to_rows(counts, [{"column": F.lit(c), "nulls": F.col(f"c{i}")} for i, c in enumerate(df.columns)])


def column_listing(df: DataFrame) -> DataFrame:
    rows = [(i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column string")


def describe(df: DataFrame, columns: Sequence[str] | None = None, small: int = SMALL) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per numeric column."""
    columns = list(columns or numeric_columns(df))
    moments = df.agg(
        *[
            F.struct(
                F.count(F.col(c)).alias("n"),
                F.avg(F.col(c)).cast("double").alias("mean"),
                F.stddev_samp(F.col(c).cast("double")).alias("std"),
                F.min(F.col(c)).cast("double").alias("min"),
                F.max(F.col(c)).cast("double").alias("max"),
            ).alias(f"m{i}")
            for i, c in enumerate(columns)
        ]
    ).first()
    series = {c: F.col(c) for c in columns}
    counts = {c: moments[i]["n"] for i, c in enumerate(columns)}
    quartiles = exact_quantiles(df, series, (0.25, 0.5, 0.75), counts, small)
    rows = [
        (
            c,
            m["n"],
            m["mean"],
            m["std"],
            m["min"],
            quartiles[(c, 0.25)],
            quartiles[(c, 0.5)],
            quartiles[(c, 0.75)],
            m["max"],
        )
        for c, m in zip(columns, moments)
    ]
    schema = "column string, n long, mean double, std double, min double, p25 double, p50 double, p75 double, max double"
    return df.sparkSession.createDataFrame(rows, schema)


def _with_shares(counts: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return counts.join(totals, list(by)).select(*columns, "n", (F.col("n") / F.col("_total")).alias("share"))


def class_shares(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and share of each class, optionally within groups."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    if by:
        return _with_shares(counts, by, [*by, label])
    total = df.count()
    return counts.select(label, "n", (F.col("n") / F.lit(total)).alias("share"))


def split_shares(df: DataFrame, label: str, split: str) -> DataFrame:
    """Class shares of the whole table and of each split, from one grouping-sets pass."""
    counts = df.groupingSets([[F.col(split), F.col(label)], [F.col(label)]], F.col(split), F.col(label)).agg(
        F.grouping(split).alias("_all"), F.count("*").alias("n")
    )
    named = counts.select(F.when(F.col("_all") == 1, "all").otherwise(F.col(split)).alias(split), label, "n")
    return _with_shares(named, [split], [split, label])


def segment_churn(df: DataFrame, label: str, dimensions: Sequence[str]) -> DataFrame:
    """Churn rate per segment against the base rate, for several dimensions in one pass.

    ``high_risk`` marks segments whose lift and one-sided two-proportion z (segment against the
    rest of the table) both reach their floors.
    """
    base = df.agg(F.count(F.col(label)).alias("n"), F.sum(F.col(label)).cast("bigint").alias("churned")).first()
    total, churned = base["n"], base["churned"] or 0
    columns = [F.col(d) for d in dimensions]
    sets = df.groupingSets([[c] for c in columns], *columns).agg(
        F.grouping_id().alias("_set"),
        F.count(F.col(label)).alias("n"),
        F.sum(F.col(label)).cast("bigint").alias("churned"),
    )
    width = len(dimensions)
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, name in enumerate(dimensions):
        mine = F.col("_set") == (1 << width) - 1 - (1 << (width - 1 - i))
        dimension = F.when(mine, F.lit(name)).otherwise(dimension)
        value = F.when(mine, F.col(name).cast("string")).otherwise(value)
    rate = ratio(F.col("churned"), F.col("n"))
    rest = ratio(F.lit(churned) - F.col("churned"), F.lit(total) - F.col("n"))
    share = churned / total if total else 0.0
    spread = F.sqrt(
        F.lit(share * (1 - share))
        * (ratio(F.lit(1), F.col("n")) + ratio(F.lit(1), F.lit(total) - F.col("n")))
    )
    return (
        sets.select(dimension.alias("dimension"), value.alias("segment_value"), "n", "churned", rate.alias("churn_rate"),
                    F.lit(share).alias("base_rate"), ratio(rate, F.lit(share)).alias("lift"),
                    ratio(rate - rest, spread).alias("z"))
        .withColumn(
            "high_risk",
            flag((F.col("lift") >= LIFT_FLOOR) & (F.col("z") >= Z_FLOOR)),
        )
    )


def normal_tail_sql(z: str) -> str:
    """The share of a normal distribution above ``z``, by a polynomial with an error of at most 7.5e-8."""
    t = f"(1D / (1D + 0.2316419D * abs({z})))"
    terms = " + ".join(f"({c!r}D) * power({t}, {i}D)" for i, c in enumerate(TAIL_POLYNOMIAL, 1))
    tail = f"(0.3989422804014327D * exp(-({z}) * ({z}) / 2D) * ({terms}))"
    return f"CASE WHEN {z} >= 0 THEN {tail} ELSE 1D - {tail} END"


def segment_search(
    df: DataFrame, label: str, dimensions: Sequence[str], least_rows: int = 30, false_discoveries: float = 0.05
) -> DataFrame:
    """All segments of one dimension and of two, with their churn against the rest of the table and a flag that holds the
    share of false discoveries down (step-up rule over all segments that were looked at).

    One pass counts all combinations as grouping sets, with partial counts in each task. z is the one-sided two-proportion
    statistic of the segment against all other rows, p_value its tail. Ranked by p-value (ties share the highest rank), a
    segment is ``found`` if some segment at its rank or below it has p_value <= ``false_discoveries`` * rank / segments.
    Segments of fewer than ``least_rows`` labelled rows, or of all rows, are not looked at. A null is a value like any other.
    """
    pairs = [(a,) for a in dimensions] + list(combinations(dimensions, 2))
    known = df.where(F.col(quoted(label)).isNotNull())
    named = known.select(
        *[F.coalesce(F.col(quoted(d)).cast("string"), F.lit("(none)")).alias(f"d{i}") for i, d in enumerate(dimensions)],
        F.col(quoted(label)).cast("bigint").alias("y"),
    )
    place = {d: i for i, d in enumerate(dimensions)}
    sets = [[F.col(f"d{place[d]}") for d in pair] for pair in pairs]
    counts = named.groupingSets(sets, *[F.col(f"d{i}") for i in range(len(dimensions))]).agg(F.count("*").alias("n"), F.sum("y").alias("churned"))
    names = [f"IF(d{i} IS NULL, NULL, {text_sql(d + '=')} || d{i})" for i, d in enumerate(dimensions)]
    total, churned = named.agg(F.count("*"), F.sum("y")).first()
    table = counts.selectExpr(
        f"concat_ws(' & ', {', '.join(names)}) AS segment", "n", "churned", f"{max(total, 1)}L AS t", f"{churned or 0}L AS c"
    )
    table = table.where(f"n >= {least_rows} AND n < t").selectExpr(
        "segment", "n", "churned", "churned / CAST(n AS double) AS churn_rate", "(c - churned) / CAST(t - n AS double) AS rest_rate",
        "sqrt((c / CAST(t AS double)) * (1D - c / CAST(t AS double)) * (1D / n + 1D / (t - n))) AS spread",
    )
    table = table.selectExpr("*", "coalesce((churn_rate - rest_rate) / nullif(spread, 0D), 0D) AS z").drop("spread")
    table = table.selectExpr("*", f"{normal_tail_sql('z')} AS p_value")
    ranked = table.groupBy("p_value").agg(F.count("*").alias("k"))  # segments are as many as the values, not the rows
    upto, whole = Window.orderBy("p_value").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    ranked = ranked.select("p_value", F.sum("k").over(upto).alias("rank"), F.sum("k").over(whole).alias("segments"))
    passed = F.col("p_value") <= F.lit(false_discoveries) * F.col("rank") / F.col("segments")
    ranked = ranked.withColumn("last", F.max(F.when(passed, F.col("rank"))).over(whole))
    joined = table.join(F.broadcast(ranked), "p_value")
    return joined.select(
        "segment", "n", "churned", "churn_rate", "rest_rate", "z", "p_value", "rank", flag(F.coalesce(F.col("rank") <= F.col("last"), F.lit(False))).alias("found")
    )


def value_range(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float] | None]:
    row = df.agg(
        *[F.min(F.col(c)).cast("double").alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c)).cast("double").alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: None if row[f"lo{i}"] is None else (row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(columns)
    }


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    if high == low:
        return F.when(value.isNotNull(), 0)
    return F.least(F.floor((value - F.lit(low)) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-width histogram of each column; empty bins appear with a zero count."""
    ranges = value_range(df, columns)
    filled = [c for c in columns if ranges[c] is not None]
    schema = "column string, bucket int, low double, high double"
    grid = []
    for c in filled:
        low, high = ranges[c]
        step = (high - low) / bins
        grid += [(c, b, low + b * step, low + (b + 1) * step) for b in range(bins)]
    edges = df.sparkSession.createDataFrame(grid, schema)
    if not filled:
        return edges.withColumn("n", F.lit(0).cast("bigint"))
    rows = [{"column": F.lit(c), "bucket": bin_index(F.col(c).cast("double"), *ranges[c], bins)} for c in filled]
    counts = to_rows(df, rows).where(F.col("bucket").isNotNull()).groupBy("column", "bucket").agg(F.count("*").alias("n"))
    return edges.join(counts, ["column", "bucket"], "left").select(
        "column", "bucket", "low", "high", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    )


def classes(df: DataFrame, label: str, limit: int = 1000) -> list:
    """The distinct class values, ascending; a column with more than ``limit`` is not a class."""
    values = df.select(F.col(quoted(label)).alias("v")).where("v IS NOT NULL")
    rows = values.distinct().orderBy("v").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{label} has more than {limit} distinct values")
    return [r[0] for r in rows]


def violin_summary(df: DataFrame, columns: Sequence[str], label: str, small: int = SMALL) -> DataFrame:
    """Exact five-number summary of each column within each class."""
    levels = classes(df, label)
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    keys = [(c, level) for c in columns for level in levels]
    series = {f"{c}|{level}": F.when(F.col(label) == F.lit(level), F.col(c)) for c, level in keys}
    found = exact_quantiles(df, series, probs, small=small)
    rows = [(c, level, *[found[(f"{c}|{level}", p)] for p in probs]) for c, level in keys]
    kind = df.schema[label].dataType.simpleString()
    schema = f"column string, {label} {kind}, low double, p25 double, p50 double, p75 double, high double"
    return df.sparkSession.createDataFrame(rows, schema)


def violin_density(df: DataFrame, column: str, label: str, bins: int = 512, grid: int = 64) -> DataFrame:
    """Gaussian kernel density of a column per class on an even grid.

    Rows are reduced to at most ``bins`` counts per class first, so the kernel sum runs over bins,
    not rows. Bandwidth: Scott's rule, n**(-1/5) times the class deviation. Values are summed from the
    column's minimum on, so a large mean costs no digits. A column without values gives no rows.
    """
    ends = value_range(df, [column])[column]
    if ends is None:
        return df.select(F.col(label), F.lit(0.0).alias("x"), F.lit(0.0).alias("density")).limit(0)
    low, high = ends
    width = (high - low) / bins or 1.0
    value = F.col(column).cast("double")
    known = df.where(value.isNotNull() & F.col(label).isNotNull())
    above = value - F.lit(low)
    binned = known.groupBy(label, bin_index(value, low, high, bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum(above).alias("s"), F.sum(above * above).alias("q")
    )
    shape = binned.groupBy(label).agg(
        F.sum("n").alias("total"),
        F.sqrt(
            F.greatest(F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2), F.lit(0.0))
        ).alias("deviation"),
    )
    bandwidth = F.greatest(F.col("deviation") * F.pow(F.col("total"), F.lit(-0.2)), F.lit(width))
    reach = high - low or 1.0
    start, step = low - reach * 0.25, reach * 1.5 / (grid - 1)
    points = F.explode(F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.lit(start) + i * F.lit(step)))
    z = (F.col("x") - F.lit(low) - F.col("s") / F.col("n")) / F.col("h")
    kernel = F.exp(z * z * -0.5) / (F.col("h") * math.sqrt(2 * math.pi))
    return (
        binned.join(shape.select(label, "total", bandwidth.alias("h")), label)
        .withColumn("x", points)
        .groupBy(label, "x")
        .agg((F.sum(F.col("n") * kernel) / F.first("total")).alias("density"))
    )


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair; NULL for a constant column.

    A first pass finds means, nulls and constant columns. The second sums products of centred values,
    one buffer per pair, which keeps the aggregation of a dozen columns in generated code. Only pairs
    with missing values need their own pairwise moments.
    """
    value = [f"CAST({quoted(c)} AS DOUBLE)" for c in columns]
    look = df.agg(
        *[
            F.expr(f"struct(count_if({v} IS NULL) AS nulls, min({v}) = max({v}) AS constant, avg({v}) AS mean) AS c{i}")
            for i, v in enumerate(value)
        ]
    ).first()
    varying = [i for i in range(len(columns)) if look[i]["constant"] is False]
    full = {i for i in varying if look[i]["nulls"] == 0}
    aggregates = []
    r: dict[tuple[int, int], str] = {}
    for i in varying:
        for j in varying:
            if i > j:
                continue
            if {i, j} <= full:
                centred = " * ".join(f"({value[c]} - {double_sql(look[c]['mean'])})" for c in (i, j))
                aggregates.append(f"sum({centred}) AS v{i}_{j}")
                scale = f"sqrt(v{i}_{i} * v{j}_{j})"
            else:
                aggregates.append(f"covar_pop({value[i]}, {value[j]}) AS v{i}_{j}")
                for name, x in (("x", value[i]), ("y", value[j])):
                    known = f"CASE WHEN {value[i]} IS NOT NULL AND {value[j]} IS NOT NULL THEN {x} END"
                    deviation = f"CASE WHEN min({known}) < max({known}) THEN stddev_pop({known}) END"
                    aggregates.append(f"{deviation} AS {name}{i}_{j}")
                scale = f"x{i}_{j} * y{i}_{j}"
            r[(i, j)] = f"try_divide(v{i}_{j}, nullif({scale}, 0.0D))"
    rows = [
        {"x": text_sql(a), "y": text_sql(b), "r": r.get((min(i, j), max(i, j)), "CAST(NULL AS DOUBLE)")}
        for i, a in enumerate(columns)
        for j, b in enumerate(columns)
    ]
    moments = df.agg(F.count("*").alias("_n"), *[F.expr(a) for a in aggregates])
    return moments.select(inline_sql(rows))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns whose values are all the same (or all null); minimum and maximum suffice."""
    ends = df.agg(
        *[
            F.coalesce(F.min(F.col(c)) == F.max(F.col(c)), F.lit(True)).alias(f"c{i}")
            for i, c in enumerate(df.columns)
        ]
    )
    return to_rows(ends, [{"column": F.lit(c), "is_constant": flag(F.col(f"c{i}"))} for i, c in enumerate(df.columns)])
