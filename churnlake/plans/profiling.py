"""Registered queries: sources and profiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators import profile as ops
from churnlake.operators.models import load_features, save_features
from churnlake.operators.prep import dummies, feature_names, fit_levels
from churnlake.plans.inputs import (
    ID,
    LABEL,
    SPEC,
    held_profile,
    profile,
    rounded,
    split_profile,
    union_all,
    with_profile,
    with_split,
)
from churnlake.plans.registry import query
from churnlake.schema import PROFILE
from churnlake.session import new_path
from churnlake.sources.files import preview, read_customers, write_customers

TYPES = {f.name: f.dataType.simpleString() for f in PROFILE.fields}
NUMERIC = ["balance", "tenure", "num_products", "has_urgent", "is_active_member", "est_spend", "year", "exited"]
BINNED = list(SPEC.numeric)

PROFILE_COLUMNS = ", ".join(TYPES)


@query("s1_csv_round_trip", with_profile(f"select {PROFILE_COLUMNS} from profile"))
def csv_round_trip(spark, folder):
    path = new_path(spark, "csv")
    write_customers(profile(spark, folder), path, "csv")
    return read_customers(spark, path, PROFILE, "csv")


@query("s1_parquet_round_trip", with_profile(f"select {PROFILE_COLUMNS} from profile"))
def parquet_round_trip(spark, folder):
    path = new_path(spark, "parquet")
    write_customers(profile(spark, folder), path, "parquet")
    return read_customers(spark, path, PROFILE, "parquet")


@query("s2_preview", with_profile(f"select {PROFILE_COLUMNS} from profile order by customer_id limit 5"))
def preview_rows(spark, folder):
    return preview(profile(spark, folder), ID)


_FEATURES_SQL = with_profile(
    """, names as (
  select * from (values (0, 0, 'balance'), (0, 1, 'tenure'), (0, 2, 'num_products'), (0, 3, 'has_urgent'),
    (0, 4, 'is_active_member'), (0, 5, 'est_spend'), (0, 6, 'year')) t(part, place, feature)
  union all
  select 1, rn, 'geography_' || v from
    (select v, cast(row_number() over (order by v) as int) rn from (select distinct geography v from profile)) where rn > 1
  union all
  select 2, rn, 'segment_' || v from
    (select v, cast(row_number() over (order by v) as int) rn from (select distinct segment v from profile)) where rn > 1)
select cast(row_number() over (order by part, place) - 1 as int) as position, feature from names"""
)


@query("s4_feature_schema", _FEATURES_SQL)
def feature_schema(spark, folder):
    levels = fit_levels(held_profile(spark, folder, *SPEC.categorical), SPEC.categorical)
    path = new_path(spark, "features")
    save_features(spark, feature_names(SPEC, levels), path)
    stored = load_features(spark, path)
    return spark.createDataFrame(list(enumerate(stored)), "position int, feature string")


@query(
    "a1_column_info",
    with_profile(
        union_all(
            *[f"select '{c}' as \"column\", '{t}' as dtype, count({c}) as non_null from profile" for c, t in TYPES.items()]
        )
    ),
)
def column_info(spark, folder):
    return ops.column_info(profile(spark, folder))


@query(
    "a2_describe",
    with_profile(
        union_all(
            *[
                f"select '{c}' as \"column\", count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, "
                f"cast(min({c}) as double) as min, round(quantile_cont(cast({c} as double), 0.25e0), 4) as p25, "
                f"round(quantile_cont(cast({c} as double), 0.5e0), 4) as p50, "
                f"round(quantile_cont(cast({c} as double), 0.75e0), 4) as p75, cast(max({c}) as double) as max from profile"
                for c in NUMERIC
            ]
        )
    ),
)
def describe(spark, folder):
    table = ops.describe(held_profile(spark, folder, *NUMERIC), NUMERIC)
    return rounded(table, 4, "mean", "std", "p25", "p50", "p75")


@query(
    "a3_null_counts",
    with_profile(
        union_all(
            *[f"select '{c}' as \"column\", count(*) filter (where {c} is null) as nulls from profile" for c in TYPES]
        )
    ),
)
def null_counts(spark, folder):
    return ops.null_counts(profile(spark, folder))


@query(
    "a3_null_counts_outer",
    """with j as (select p_partkey, p_type, l_orderkey, l_quantity from part left join lineitem
  on l_partkey = p_partkey and l_discount > 0.09e0)
"""
    + union_all(
        *[
            f"select '{c}' as \"column\", count(*) filter (where {c} is null) as nulls from j"
            for c in ("p_partkey", "p_type", "l_orderkey", "l_quantity")
        ]
    ),
)
def null_counts_outer(spark, folder):
    """Null counts of a table that does have nulls: parts without a deeply discounted line."""
    from churnlake.sources.tables import table

    lines = table(spark, folder, "lineitem").where(F.col("l_discount") > 0.09)
    joined = table(spark, folder, "part").join(lines, F.col("l_partkey") == F.col("p_partkey"), "left")
    return ops.null_counts(joined.select("p_partkey", "p_type", "l_orderkey", "l_quantity"))


@query(
    "a4_column_listing",
    with_profile(
        ', n as (select count(*) as n_rows from profile)\nselect t.*, n_rows from (values '
        + ", ".join(f"({i}, '{c}')" for i, c in enumerate(TYPES))
        + ') t(position, "column"), n'
    ),
)
def column_listing(spark, folder):
    """The columns in order, with the number of rows that they hold."""
    rows = profile(spark, folder)
    return ops.column_listing(rows).join(F.broadcast(rows.agg(F.count("*").alias("n_rows"))))


@query("a4_projection", with_profile("select customer_id, balance from profile"))
def projection(spark, folder):
    return profile(spark, folder).select(ID, "balance")


@query(
    "a5_class_distribution",
    with_profile(
        "select exited, count(*) as n, round(count(*) / cast(sum(count(*)) over () as double), 6) as share "
        "from profile group by exited"
    ),
)
def class_distribution(spark, folder):
    return rounded(ops.class_shares(profile(spark, folder), LABEL))


@query(
    "a6_split_distribution",
    with_split(
        """select split, exited, count(*) as n,
  round(count(*) / cast(sum(count(*)) over (partition by split) as double), 6) as share
from (select split, exited from split union all select 'all', exited from split) group by split, exited"""
    ),
)
def split_distribution(spark, folder):
    return rounded(ops.split_shares(split_profile(spark, folder), LABEL, "split"))


_SEGMENTS = {
    "geography": "geography",
    "segment": "segment",
    "num_products": "cast(num_products as varchar)",
    "is_active_member": "cast(is_active_member as varchar)",
}


def _searched_sql() -> str:
    """All segments of one and two dimensions, with the step-up rule."""
    names = list(_SEGMENTS)
    one = [(f"'{d}=' || coalesce({_SEGMENTS[d]}, '(none)')", d) for d in names]
    two = [
        (f"'{a}=' || coalesce({_SEGMENTS[a]}, '(none)') || ' & {b}=' || coalesce({_SEGMENTS[b]}, '(none)')", f"{a}, {b}")
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    counts = union_all(
        *[f"select {label} as segment, count(*) as n, cast(sum(exited) as bigint) as churned from known group by {by}" for label, by in one + two]
    )
    t = "(1e0 / (1e0 + 0.2316419e0 * abs(z)))"
    terms = " + ".join(f"({c!r}) * pow({t}, {i})" for i, c in enumerate(ops.TAIL_POLYNOMIAL, 1))
    tail = f"(0.3989422804014327e0 * exp(-z * z / 2) * ({terms}))"
    return f""", known as (select * from profile where exited is not null),
base as (select count(*) t, sum(exited) c from known),
counts as ({counts}),
rates as (
  select segment, n, churned, cast(churned as double) / n as churn_rate, cast(c - churned as double) / (t - n) as rest_rate,
    sqrt((cast(c as double) / t) * (1 - cast(c as double) / t) * (1e0 / n + 1e0 / (t - n))) as spread
  from counts, base where n >= 30 and n < t),
scored as (select *, coalesce((churn_rate - rest_rate) / nullif(spread, 0), 0) as z from rates),
tails as (select *, case when z >= 0 then {tail} else 1 - {tail} end as p from scored),
ranked as (select *, count(*) over (order by p range unbounded preceding) as rank, count(*) over () as m from tails),
last as (select max(rank) as last from ranked where p <= 0.05e0 * rank / m)
select segment, n, churned, round(churn_rate, 6) as churn_rate, round(rest_rate, 6) as rest_rate, round(z, 5) as z, round(p, 6) as p_value, rank,
  cast(coalesce(rank <= last, false) as int) as found
from ranked, last"""


@query("a7_segment_search", with_profile(_searched_sql()))
def segment_search(spark, folder):
    found = ops.segment_search(profile(spark, folder), "exited", list(_SEGMENTS))
    return rounded(rounded(found, 6, "churn_rate", "rest_rate", "p_value"), 5, "z")


@query(
    "a7_segment_churn",
    with_profile(
        ", base as (select count(*) t, cast(sum(exited) as double) c from profile), seg as ("
        + union_all(
            *[
                f"select '{d}' as dimension, {v} as segment_value, count(*) as n, cast(sum(exited) as bigint) as churned "
                f"from profile group by {d}"
                for d, v in _SEGMENTS.items()
            ]
        )
        + """),
rates as (
  select dimension, segment_value, n, churned, cast(churned as double) / n as churn_rate, c / t as base_rate,
    (cast(churned as double) / n) / (c / t) as lift,
    (cast(churned as double) / n - (c - churned) / nullif(t - n, 0))
      / nullif(sqrt((c / t) * (1 - c / t) * (1e0 / n + 1e0 / nullif(t - n, 0))), 0) as z
  from seg, base)
select dimension, segment_value, n, churned, round(churn_rate, 6) as churn_rate, round(base_rate, 6) as base_rate,
  round(lift, 6) as lift, round(z, 6) as z, cast(case when lift >= 1.25e0 and z >= 1.645e0 then 1 else 0 end as int) as high_risk
from rates"""
    ),
)
def segment_churn(spark, folder):
    return rounded(ops.segment_churn(held_profile(spark, folder, LABEL, *_SEGMENTS), LABEL, list(_SEGMENTS)))


@query(
    "a8_histogram",
    with_profile(
        ", ends as ("
        + union_all(
            *[f"select '{c}' as \"column\", min({c})::double lo, max({c})::double hi from profile" for c in BINNED]
        )
        + "), vals as ("
        + union_all(*[f"select '{c}' as \"column\", cast({c} as double) v from profile" for c in BINNED])
        + """), cells as (select "column", b as bucket, lo, hi from ends, range(10) r(b)),
hits as (
  select "column", cast(case when hi > lo then least(floor((v - lo) / (hi - lo) * 10), 9) else 0 end as int) as bucket,
    count(*) as n
  from vals join ends using ("column") group by 1, 2)
select cells."column", cast(cells.bucket as int) as bucket, round(lo + cells.bucket * ((hi - lo) / 10), 4) as low,
  round(lo + (cells.bucket + 1) * ((hi - lo) / 10), 4) as high, coalesce(n, 0) as n
from cells left join hits on hits."column" = cells."column" and hits.bucket = cells.bucket"""
    ),
)
def histogram(spark, folder):
    return rounded(ops.histogram(held_profile(spark, folder, *BINNED), BINNED), 4)


@query(
    "a9_violin_summary",
    with_profile(
        union_all(
            *[
                f"select '{c}' as \"column\", exited, min({c})::double as low, "
                + ", ".join(
                    f"round(quantile_cont(cast({c} as double), {p}e0), 4) as p{int(p * 100)}" for p in (0.25, 0.5, 0.75)
                )
                + f", max({c})::double as high from profile group by exited"
                for c in BINNED
            ]
        )
    ),
)
def violin_summary(spark, folder):
    return rounded(ops.violin_summary(held_profile(spark, folder, *BINNED, LABEL), BINNED, LABEL), 4)


def _density_sql(c: str) -> str:
    return f"""{c}_e as (select cast(min({c}) as double) lo, cast(max({c}) as double) hi from profile),
{c}_b as (
  select exited, cast(case when hi > lo then least(floor(({c} - lo) / (hi - lo) * 512), 511) else 0 end as int) bin,
    count(*) n, sum({c} - lo) s from profile, {c}_e where {c} is not null group by 1, 2),
{c}_g as (
  select exited, cast(count({c}) as double) total,
    greatest(sqrt(var_pop(cast({c} as double))) * pow(cast(count({c}) as double), -0.2e0),
      any_value(case when hi > lo then (hi - lo) / 512 else 1e0 end)) hh
  from profile, {c}_e group by exited),
{c}_x as (
  select lo, lo - w * 0.25e0 + i * (w * 1.5e0 / 63) x
  from (select lo, case when hi > lo then hi - lo else 1e0 end w from {c}_e), range(64) t(i))"""


def _density_rows(c: str) -> str:
    return f"""select '{c}' as "column", exited, round(x, 4) as x,
  round(sum(n * exp(pow((x - lo - s / n) / hh, 2) * -0.5e0) / (hh * sqrt(2 * pi()))) / any_value(total), 9) as density
from {c}_b join {c}_g using (exited), {c}_x group by exited, x"""


@query(
    "a9_violin_density",
    with_profile(", " + ",\n".join(map(_density_sql, BINNED)) + "\n" + union_all(*map(_density_rows, BINNED))),
)
def violin_density(spark, folder):
    rows = held_profile(spark, folder, *BINNED, LABEL)
    tables = [ops.violin_density(rows, c, LABEL).select(F.lit(c).alias("column"), LABEL, "x", "density") for c in BINNED]
    return rounded(rounded(reduce(DataFrame.unionByName, tables), 4, "x"), 9, "density")


_PAIRS = [(a, b) for a in NUMERIC for b in NUMERIC]


@query(
    "a10_correlation",
    with_profile(
        union_all(
            *[
                f"select '{a}' as x, '{b}' as y, round(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 6) "
                f"+ 0e0 as r from profile where {a} is not null and {b} is not null"
                for a, b in _PAIRS
            ]
        )
    ),
)
def correlation(spark, folder):
    return rounded(ops.correlation(profile(spark, folder), NUMERIC))


@query(
    "a11_constant_columns",
    with_profile(
        union_all(
            *[
                f"select '{c}' as \"column\", cast(case when coalesce(min({c}) = max({c}), true) then 1 else 0 end as int) "
                "as is_constant from profile"
                for c in TYPES
            ]
        )
    ),
)
def constant_columns(spark, folder):
    return ops.constant_columns(profile(spark, folder))
