"""Inputs of the registered queries, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.functions.expressions import linear_margin, sigmoid, to_rows
from churnlake.operators.split import stratified_split
from churnlake.schema import PROFILE_TABLE
from churnlake.session import staged
from churnlake.sources.tables import customer_profile

SPEC = PROFILE_TABLE
ID, LABEL = SPEC.id, SPEC.label

# Fixed scorers: weights of a logistic score on profile columns, rounded to 4 digits.
ENGAGEMENT = ({"is_active_member": -0.9, "num_products": -0.15, "balance": 0.00002}, 0.21)
SPENDING = ({"has_urgent": -0.5, "tenure": 0.1, "est_spend": -0.000001}, -1.0)
SCORERS = {"engagement": ENGAGEMENT, "spending": SPENDING}


def linear_score(name: str = "engagement") -> Column:
    weights, intercept = SCORERS[name]
    return F.round(sigmoid(linear_margin(weights, intercept)), 4)


def profile(spark: SparkSession, folder: str) -> DataFrame:
    return customer_profile(spark, folder)


def held_profile(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The profile (all or only these columns) written once, for queries that pass over it several times.
    Columns that nobody asked for cost no join and no scan."""
    rows = profile(spark, folder)
    return staged(rows.select(*columns) if columns else rows, "profile")


def score_rows(rows: DataFrame, *models: str) -> DataFrame:
    """(customer_id, label, model, score) for each fixed scorer, from one scan."""
    lines = [{"model": F.lit(m), "score": linear_score(m)} for m in models or SCORERS]
    return to_rows(rows.withColumn("label", F.col(LABEL)), lines, [ID, "label"])


def scored(spark: SparkSession, folder: str, *models: str) -> DataFrame:
    return score_rows(profile(spark, folder), *models)


def split_profile(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Id, label, these columns and the split, which is a comparison with constants."""
    return stratified_split(held_profile(spark, folder, ID, LABEL, *columns), LABEL, ID)


def whole_split(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_split(held_profile(spark, folder), LABEL, ID)


def rounded(df: DataFrame, digits: int = 6, *columns: str) -> DataFrame:
    """Round double columns (all, or those named) so sums in another order compare equal."""
    wanted = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in wanted})


PROFILE_CTE = """
h as (
  select o_custkey, min(o_orderdate) first_order, max(o_orderdate) last_order,
    sum(case when o_orderdate >= timestamp '1999-01-01' then cast(o_totalprice as decimal(18,2)) else 0 end) spend_1y,
    max(case when o_orderpriority = '1-URGENT' then 1 else 0 end) has_urgent
  from orders where o_orderdate < timestamp '2000-01-01' group by o_custkey),
pr as (
  select o_custkey, count(distinct p_type) num_products
  from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
  where o_orderdate >= timestamp '1999-01-01' and o_orderdate < timestamp '2000-01-01' group by o_custkey),
fu as (
  select distinct o_custkey from orders
  where o_orderdate >= timestamp '2000-01-01' and o_orderdate < timestamp '2001-01-01'),
profile as (
  select c.c_custkey customer_id, c.c_name surname, r.r_name geography, c.c_mktsegment segment, c.c_acctbal balance,
    cast(2000 - year(h.first_order) as int) tenure,
    cast(coalesce(pr.num_products, 0) as int) num_products, cast(h.has_urgent as int) has_urgent,
    cast(case when h.last_order >= timestamp '1999-07-01' then 1 else 0 end as int) is_active_member,
    cast(h.spend_1y as double) est_spend, cast(1999 as int) as year,
    cast(case when fu.o_custkey is null then 1 else 0 end as int) exited
  from customer c join nation n on n.n_nationkey = c.c_nationkey join region r on r.r_regionkey = n.n_regionkey
  join h on h.o_custkey = c.c_custkey left join pr on pr.o_custkey = c.c_custkey
  left join fu on fu.o_custkey = c.c_custkey)"""

ENGAGEMENT_MARGIN = "(0.21e0 + (-0.9e0) * is_active_member + (-0.15e0) * num_products + 0.00002e0 * balance)"
ENGAGEMENT_SQL = f"round(1e0 / (1e0 + exp(-{ENGAGEMENT_MARGIN})), 4)"
SPENDING_SQL = (
    "round(1e0 / (1e0 + exp(-(-1.0e0 + (-0.5e0) * has_urgent + 0.1e0 * tenure + (-0.000001e0) * est_spend))), 4)"
)

SCORED_CTE = f"""{PROFILE_CTE},
scored as (select *, exited as label, 'engagement' as model, {ENGAGEMENT_SQL} as score from profile)"""

MODELS_CTE = f"""{PROFILE_CTE},
scored as (
  select *, exited as label, 'engagement' as model, {ENGAGEMENT_SQL} as score from profile
  union all
  select *, exited as label, 'spending' as model, {SPENDING_SQL} as score from profile)"""

SPLIT_CTE = f"""{PROFILE_CTE},
sizes as (select exited, count(*) n_c from profile group by exited),
wanted as (select cast(ceil(round(0.2e0 * sum(n_c), 6)) as bigint) w, cast(sum(n_c) as bigint) n from sizes),
shares as (select exited, (n_c * w) // n as whole, (n_c * w) % n as rest, w from sizes, wanted),
allotted as (
  select exited, whole + case when row_number() over (order by rest desc, exited) <= w - sum(whole) over ()
    then 1 else 0 end as n_test from shares),
keyed as (select *, substr(md5(cast(customer_id as varchar) || ':42'), 1, 13) as k from profile),
split as (
  select keyed.*, case when row_number() over (partition by keyed.exited order by k, customer_id) <= n_test
    then 'test' else 'train' end as split
  from keyed join allotted using (exited))"""


def with_profile(body: str) -> str:
    return f"with {PROFILE_CTE}\n{body}"


def with_scored(body: str) -> str:
    return f"with {SCORED_CTE}\n{body}"


def with_models(body: str) -> str:
    return f"with {MODELS_CTE}\n{body}"


def with_split(body: str) -> str:
    return f"with {SPLIT_CTE}\n{body}"


def union_all(*parts: str) -> str:
    return "\nunion all\n".join(parts)
