"""Risk bands, lists, scenarios and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from churnlake.operators import explain, scoring
from churnlake.session import new_path
from churnlake.streaming import monitor


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, "hot" if i % 3 else "cold", i % 2, (i * 37 % 100) / 100) for i in range(300)]
    return spark.createDataFrame(rows, "id long, region string, active int, score double")


def test_bands(spark):
    df = spark.createDataFrame([(1, 0.29), (2, 0.3), (3, 0.4), (4, None)], "id long, score double")
    rows = scoring.risk_scores(df, "id").orderBy("id").collect()
    assert [r["band"] for r in rows] == ["low", "medium", "high", None]
    assert [r["risk_score"] for r in rows] == [29, 30, 40, None]


def test_top_of_each_group(scored):
    rows = scoring.high_risk_per_group(scored, "region", "id", 4).collect()
    for region in ("hot", "cold"):
        mine = sorted((r["score"], -r["id"]) for r in scored.where(F.col("region") == region).collect())[-4:]
        assert sorted((r["score"], -r["id"]) for r in rows if r["region"] == region) == mine


def test_top_of_each_group_is_limited_before_the_shuffle(scored):
    plan = scoring.high_risk_per_group(scored, "region", "id", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_retention_targets(spark, scored):
    contacted = spark.createDataFrame([(i,) for i in range(0, 300, 4)] * 5, "id long")
    segment = scored.where("region = 'hot'")
    rows = scoring.retention_targets(scored, "id", "active", 20, segment=segment, contacted=contacted).collect()
    expected = sorted(
        ((-s, i) for i, region, active, s in map(tuple, scored.collect()) if region == "hot" and not active and s > 0.4 and i % 4),
    )[:20]
    assert [(-r["score"], r["id"]) for r in rows] == expected


def test_scenarios(scored):
    score = explain.score_column(F.col("active") * -0.5 + F.lit(1.0))
    rows = scored.select("id", "active", "region")
    out = scoring.scenario_scores(rows, {"wake": {"active": 1}, "same": {}}, score, "id")
    assert out.count() == 600
    assert out.where("scenario = 'same' AND change != 0").count() == 0
    summary = {r["scenario"]: r for r in scoring.scenario_summary(out).collect()}
    assert summary["wake"]["mean_score"] == 0.5 and summary["same"]["mean_change"] == 0


def test_key_drivers(spark):
    one = spark.createDataFrame([("a", 0.9), ("b", 0.1)], "feature string, importance double")
    two = spark.createDataFrame([("a", 0.2), ("b", 0.8)], "feature string, importance double")
    rows = {r["feature"]: r for r in scoring.key_drivers({"m1": one, "m2": two}).collect()}
    assert (rows["a"]["m1"], rows["a"]["m2"], rows["b"]["m1"]) == (1, 2, 2)


def _events(day, *hours):
    start = dt.datetime(2024, 1, day)
    return [(start + dt.timedelta(hours=h), "error" if i % 2 else "view", 1.5) for i, h in enumerate(hours)]


def test_windows_close_with_the_watermark_and_late_rows_are_dropped(spark):
    schema = "ts timestamp, event_type string, value double"
    source = new_path(spark, "late")
    batches = [_events(1, 1, 2, 3), _events(2, 5, 6), _events(2, 8), _events(1, 4), _events(3, 7)]
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
    stream = monitor.read_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1)
    out, progress = new_path(spark, "windows"), new_path(spark, "progress")
    windows = monitor.indicator_windows(stream)
    monitor.append_to_table(windows, out, progress, once=True).awaitTermination()
    rows = spark.read.schema(windows.schema).parquet(out).collect()
    counts = {}
    for r in rows:
        counts[r["window_start"].day] = counts.get(r["window_start"].day, 0) + r["n"]
    assert counts == {1: 3, 2: 3}


def test_stream_resumes_where_it_stopped(spark):
    schema = "id long, x double"
    source, out, progress = (new_path(spark, n) for n in ("in", "out", "progress"))
    score = explain.score_column(F.col("x") * 2)
    for ids in ([1, 2], [3]):
        spark.createDataFrame([(i, i / 10) for i in ids], schema).write.mode("append").parquet(source)
        stream = monitor.read_stream(spark, source, spark.read.parquet(source).schema)
        monitor.append_to_table(monitor.score_stream(stream, score, "id"), out, progress, once=True).awaitTermination()
    assert sorted((r["id"], r["score"]) for r in spark.read.parquet(out).collect()) == [(1, 0.2), (2, 0.4), (3, 0.6)]
