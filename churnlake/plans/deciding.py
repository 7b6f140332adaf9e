"""Registered queries: risk bands, target lists, scenarios, streams."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.operators import explain, scoring
from churnlake.operators.models import fit_model, with_score
from churnlake.plans.inputs import (
    ID,
    SPEC,
    linear_score,
    profile,
    rounded,
    whole_split,
    with_scored,
    with_split,
)
from churnlake.plans.registry import query
from churnlake.session import new_path, written
from churnlake.sources.tables import table
from churnlake.streaming import alerts, monitor, serving


def _scored_profile(spark, folder) -> DataFrame:
    return profile(spark, folder).withColumn("score", linear_score())


@query(
    "b2_risk_bands",
    with_scored(
        """select customer_id, score, cast(round(score * 100) as int) as risk_score,
  case when score < 0.3e0 then 'low' when score < 0.4e0 then 'medium'
    when score >= 0.4e0 then 'high' end as band from scored"""
    ),
)
def risk_bands(spark, folder):
    return scoring.risk_scores(_scored_profile(spark, folder), ID)


@query(
    "b2_band_sizes",
    with_scored(
        """select case when score < 0.3e0 then 'low' when score < 0.4e0 then 'medium'
    when score >= 0.4e0 then 'high' end as band,
  count(*) as n, cast(sum(label) as bigint) as churned from scored group by 1"""
    ),
)
def band_sizes(spark, folder):
    rows = _scored_profile(spark, folder)
    return rows.groupBy(scoring.risk_band(F.col("score")).alias("band")).agg(
        F.count("*").alias("n"), F.sum("exited").cast("bigint").alias("churned")
    )


@query(
    "b3_high_risk_list",
    with_scored("select customer_id, geography, score from scored order by score desc, customer_id limit 50"),
)
def high_risk_list(spark, folder):
    return scoring.high_risk_list(_scored_profile(spark, folder), ID, 50).select(ID, "geography", "score")


@query(
    "b3_high_risk_per_region",
    with_scored(
        """select geography, cast(place as int) as place, customer_id, score from (
  select *, row_number() over (partition by geography order by score desc, customer_id) as place from scored)
where place <= 10"""
    ),
)
def high_risk_per_region(spark, folder):
    rows = scoring.high_risk_per_group(_scored_profile(spark, folder), "geography", ID, 10)
    return rows.select("geography", "place", ID, "score")


SCENARIOS = {
    "activate": {"is_active_member": 1},
    "two_more_products": {"num_products": 6},
    "activate_and_sell": {"is_active_member": 1, "num_products": 6},
}


def _scenario_score(active: str, products: str) -> str:
    return (
        f"round(1e0 / (1e0 + exp(-(0.21e0 + (-0.9e0) * {active} + (-0.15e0) * {products} + 0.00002e0 * balance))), 4)"
    )


_SCENARIO_SQL = f""", what_if as (
  select customer_id, s.scenario, score as base_score,
    {_scenario_score("coalesce(a, is_active_member)", "coalesce(p, num_products)")} as new_score
  from scored, (values ('activate', 1, null), ('two_more_products', null, 6), ('activate_and_sell', 1, 6)) s(scenario, a, p))"""


@query(
    "b4_scenarios",
    with_scored(
        f"""{_SCENARIO_SQL}
select customer_id, scenario, base_score, new_score as score, round(new_score - base_score, 6) + 0e0 as change from what_if"""
    ),
)
def scenarios(spark, folder):
    rows = profile(spark, folder)
    table_ = scoring.scenario_scores(rows, SCENARIOS, explain.score_column(linear_score()), ID)
    return rounded(table_, 6, "change")


@query(
    "b4_scenario_summary",
    with_scored(
        f"""{_SCENARIO_SQL}
select scenario, count(*) as n, round(avg(base_score), 6) as mean_base, round(avg(new_score), 6) as mean_score,
  round(avg(new_score - base_score), 6) as mean_change, count(*) filter (where base_score > 0.4e0) as high_before,
  count(*) filter (where new_score > 0.4e0) as high_after from what_if group by scenario"""
    ),
)
def scenario_summary(spark, folder):
    rows = profile(spark, folder)
    table_ = scoring.scenario_scores(rows, SCENARIOS, explain.score_column(linear_score()), ID)
    return rounded(scoring.scenario_summary(table_))


@query(
    "b5_retention_targets",
    with_scored(
        """select customer_id, score from scored
where is_active_member = 0 and score > 0.4e0 and segment in ('MACHINERY', 'HOUSEHOLD')
  and customer_id not in (select user_id from events where event_type = 'purchase' and user_id is not null)
order by score desc, customer_id limit 100"""
    ),
)
def retention_targets(spark, folder):
    rows = _scored_profile(spark, folder)
    customers = table(spark, folder, "customer").where(F.col("c_mktsegment").isin("MACHINERY", "HOUSEHOLD"))
    wanted = customers.select(F.col("c_custkey").alias(ID))
    reached = table(spark, folder, "events").where(F.col("event_type") == "purchase")
    contacted = reached.where(F.col("user_id").isNotNull()).select(F.col("user_id").alias(ID))
    targets = scoring.retention_targets(rows, ID, SPEC.active, 100, segment=wanted, contacted=contacted)
    return targets.select(ID, "score")


@query("f1_stream_scores", with_scored("select customer_id, score from scored"))
def stream_scores(spark, folder):
    """Customers arriving as files, scored by a stream and read back from its sink."""
    arriving = profile(spark, folder)
    source = written(arriving, "arriving")
    stream = monitor.read_stream(spark, source, arriving.schema, files_per_trigger=4)
    path, progress = new_path(spark, "scores"), new_path(spark, "progress")
    scored = monitor.score_stream(stream, explain.score_column(linear_score()), ID)
    monitor.append_to_table(scored, path, progress, once=True).awaitTermination()
    return spark.read.schema(scored.schema).parquet(path)


@query(
    "f1_stream_model_scores",
    with_split("select count(*) as n, count(*) as same_score from split where split = 'test'"),
)
def stream_model_scores(spark, folder):
    """A fitted pipeline gives streamed rows the scores it gives the same rows in a batch."""
    rows = whole_split(spark, folder)
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    fitted = fit_model(train, SPEC, "decision_tree")
    stream = monitor.read_stream(spark, written(test, "arriving"), test.schema)

    def rescore(df: DataFrame) -> DataFrame:
        return with_score(fitted.pipeline.transform(df))

    path, progress = new_path(spark, "scores"), new_path(spark, "progress")
    scored = monitor.score_stream(stream, rescore, ID)
    monitor.append_to_table(scored, path, progress, once=True).awaitTermination()
    streamed = spark.read.schema(scored.schema).parquet(path).withColumnRenamed("score", "streamed")
    batch = fitted.score(test).select(ID, "score")
    return batch.join(streamed, ID, "full_outer").agg(
        F.count("*").alias("n"), F.count_if(F.col("score") == F.col("streamed")).alias("same_score")
    )


@query(
    "f1_restarted_serving",
    with_split(
        "select count(*) as n, count(distinct customer_id) as customers, count(*) as same_score, cast(2 as bigint) as versions "
        "from split where split = 'test'"
    ),
)
def restarted_serving(spark, folder):
    """A stream that breaks off after its second batch is written, and is started again with a newer model: every customer is
    scored once, by the model of its batch."""
    rows = whole_split(spark, folder)
    train, test = (rows.where(F.col("split") == s) for s in ("train", "test"))
    fitted = [fit_model(train, SPEC, "decision_tree", maxDepth=d) for d in (2, 5)]
    registry, target, progress, source = (new_path(spark, x) for x in ("registry", "served", "progress", "arriving"))
    test.repartition(4).write.parquet(source)
    arriving = monitor.read_stream(spark, source, test.schema, files_per_trigger=1)

    def break_off(batch: int) -> None:
        if batch == 1:
            raise RuntimeError("stopped after the batch was written, before it was noted as done")

    serving.publish_model(spark, fitted[0], registry)
    broken = serving.serve_scores(arriving, registry, target, progress, ID, once=True, after_batch=break_off)
    try:
        broken.awaitTermination()
    except StreamingQueryException:
        pass
    serving.publish_model(spark, fitted[1], registry)
    serving.serve_scores(arriving, registry, target, progress, ID, once=True).awaitTermination()
    served = serving.served_scores(spark, target)
    own = [m.score(test).select(ID, F.col("score").alias("own"), F.lit(v).alias("version")) for v, m in enumerate(fitted, 1)]
    both = served.join(own[0].unionByName(own[1]), [ID, "version"], "left")
    return both.agg(
        F.count("*").alias("n"),
        F.countDistinct(ID).alias("customers"),
        F.count_if(F.col("score") == F.col("own")).alias("same_score"),
        F.countDistinct("version").alias("versions"),
    )


_WINDOWS = """select date_trunc('day', ts) as window_start, date_trunc('day', ts) + interval 1 day as window_end, event_type,
  count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 1, 2, 3"""


def _readable(windows: DataFrame) -> DataFrame:
    return windows.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "event_type",
        "n",
        F.col("total").cast("double").alias("total"),
    )


@query("f2_indicator_windows", _WINDOWS)
def indicator_windows(spark, folder):
    return _readable(monitor.indicator_windows(table(spark, folder, "events")))


_ALERTS = """with recursive windows as (
  select event_type, date_trunc('day', ts) as s, count(*) as n from events group by 1, 2),
numbered as (select *, row_number() over (partition by event_type order by s) as i, lag(s) over (partition by event_type order by s) as before from windows),
steps as (
  select event_type, s, n, i, cast(null as double) as expected, cast(n as double) as level from numbered where i = 1
  union all
  select w.event_type, w.s, w.n, w.i,
    case when w.s - p.s < interval 4 day then p.level end,
    case when w.s - p.s < interval 4 day then p.level + 0.3e0 * (w.n - p.level) else cast(w.n as double) end
  from steps p join numbered w on w.event_type = p.event_type and w.i = p.i + 1)
select event_type as indicator, s as window_start, n, round(expected, 6) as expected, case when n > expected then 'rise' else 'fall' end as kind
from steps where abs(n - expected) > 1e0 * sqrt(greatest(expected, 1e0))
union all
select a.event_type, a.s + interval 1 day, 0, round(a.level, 6), 'silent'
from steps a left join steps b on b.event_type = a.event_type and b.i = a.i + 1
where b.s is null or b.s - a.s >= interval 4 day"""


@query("f2_change_alerts", _ALERTS)
def change_alerts(spark, folder):
    """All events arrive in four parts, each taken up by a restart of the same two streams (events to closed windows, windows
    to alerts); events far later close all windows, and their own indicator is left out."""
    events = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    if low is None:
        return spark.createDataFrame([], alerts.ALERTS)
    days = ((high.date() - low.date()).days + 1) / 4
    part = F.least(F.floor(F.datediff(F.col("ts").cast("date"), F.lit(low.date())) / days), F.lit(3))
    source, closed, path, counted, progress = (new_path(spark, x) for x in ("arriving-events", "closed", "alerts", "counted", "progress"))
    last = events.limit(1).select(F.lit(high).cast("timestamp").alias("ts"), F.lit("(end)").alias("event_type"), "value")
    ends = [last.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {d} DAYS")) for d in (100, 200)]
    for rows in [*(events.where(part == i) for i in range(4)), *ends]:
        rows.write.mode("append").parquet(source)
        windows = monitor.indicator_windows(monitor.read_stream(spark, source, events.schema))
        monitor.append_to_table(windows, closed, counted, once=True).awaitTermination()
        found = alerts.change_alerts(monitor.read_stream(spark, closed, windows.schema), width=1.0)
        monitor.append_to_table(found, path, progress, once=True).awaitTermination()
    told = spark.read.schema(alerts.ALERTS).parquet(path).where("indicator <> '(end)'")
    return told.select("indicator", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n", F.round("expected", 6).alias("expected"), "kind")


@query(
    "f2_alert_share",
    f"""with w as ({_WINDOWS})
select window_start, cast(sum(n) as bigint) as n,
  round(cast(sum(case when event_type = 'error' then n else 0 end) as double) / sum(n), 6) as alert_share
from w group by window_start""",
)
def alert_share(spark, folder):
    shares = monitor.alert_share(monitor.indicator_windows(table(spark, folder, "events")))
    return rounded(shares.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query(
    "f2_stream_windows",
    f"""with w as ({_WINDOWS}), latest as (select max(ts) as m from events)
select w.* from w, latest where window_end <= m - interval 1 hour""",
)
def stream_windows(spark, folder):
    """Windows a stream over the events has closed: those the watermark has passed."""
    stream = monitor.read_stream(spark, f"{folder}/events.parquet*", table(spark, folder, "events").schema)
    path, progress = new_path(spark, "windows"), new_path(spark, "progress")
    windows = monitor.indicator_windows(stream)
    monitor.append_to_table(windows, path, progress, once=True).awaitTermination()
    return _readable(spark.read.schema(windows.schema).parquet(path))
