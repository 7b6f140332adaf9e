import math
import random

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from churnlake.operators import profile
from churnlake.operators.models import fit_model
from churnlake.schema import BANK_TABLE as SPEC
from churnlake.session import new_path
from churnlake.streaming import alerts, monitor, serving


def test_alerts_equal_a_plain_recursion(spark):
    pick = random.Random(4)
    day = pd.Timestamp("2024-03-01")
    at = lambda d: (day + pd.Timedelta(days=d)).to_pydatetime()
    counts = {
        "a": {d: pick.randrange(80, 120) + (200 if d == 9 else 0) for d in range(20)},
        "b": {d: pick.randrange(5, 9) for d in range(20) if d not in (6, 7, 8, 9, 12, 13)},
    }
    expected = []
    for name, windows in counts.items():
        level, last = None, None
        for d, n in sorted(windows.items()):
            if last is not None and d - last - 1 >= 3:
                expected.append((name, last + 1, 0, "silent"))
                level = None
            if level is not None and abs(n - level) > 2 * math.sqrt(max(level, 1)):
                expected.append((name, d, n, "rise" if n > level else "fall"))
            level, last = float(n) if level is None else level + 0.3 * (n - level), d
        expected.append((name, last + 1, 0, "silent"))
    source, path, progress = (new_path(spark, x) for x in ("windows", "alerts", "progress"))
    schema = "window_start timestamp, window_end timestamp, event_type string, n long"
    from pyspark.sql.types import _parse_datatype_string

    for part in (range(0, 5), range(5, 6), range(6, 14), range(14, 20), [40], [80]):  # a restart for each
        rows = [(at(d), at(d + 1), k, w[d]) for k, w in counts.items() for d in part if d in w]
        rows = rows or [(at(part[0]), at(part[0] + 1), "(end)", 1)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        found = alerts.change_alerts(monitor.read_stream(spark, source, _parse_datatype_string(schema)), width=2.0)
        monitor.append_to_table(found, path, progress, once=True).awaitTermination()
    got = spark.read.schema(alerts.ALERTS).parquet(path).where("indicator <> '(end)'").collect()
    assert sorted((r.indicator, (pd.Timestamp(r.window_start) - day).days, r.n, r.kind) for r in got) == sorted(expected)
    assert {r.kind for r in got} == {"rise", "fall", "silent"} or {r.kind for r in got} == {"rise", "silent"}


def test_serving_survives_a_failure_and_takes_up_a_new_model(spark, bank):
    rows = bank.where("CustomerId % 8 = 0")
    models = [fit_model(rows, SPEC, "decision_tree", maxDepth=d) for d in (1, 4)]
    registry, target, progress, source = (new_path(spark, x) for x in ("registry", "served", "progress", "arriving"))
    rows.repartition(3).write.parquet(source)
    arriving = monitor.read_stream(spark, source, rows.schema, files_per_trigger=1)
    calls = []

    def fail_once(batch):
        calls.append(batch)
        if calls == [0, 1]:
            raise RuntimeError("lost")

    with pytest.raises(ValueError):
        serving.newest_model(spark, registry)
    assert serving.publish_model(spark, models[0], registry) == 1
    with pytest.raises(StreamingQueryException):
        serving.serve_scores(arriving, registry, target, progress, SPEC.id, True, fail_once).awaitTermination()
    assert serving.publish_model(spark, models[1], registry) == 2
    serving.serve_scores(arriving, registry, target, progress, SPEC.id, True, fail_once).awaitTermination()
    assert calls == [0, 1, 1, 2]  # the second batch was replayed
    served = serving.served_scores(spark, target)
    assert served.count() == rows.count() == served.select(SPEC.id).distinct().count()
    assert {(r["batch"], r["version"]) for r in served.select("batch", "version").distinct().collect()} == {(0, 1), (1, 1), (2, 2)}
    for version, model in enumerate(models, 1):
        own = model.score(rows).select(SPEC.id, F.col("score").alias("own"))
        assert served.where(F.col("version") == version).join(own, SPEC.id).where("score <> own").isEmpty()


def test_segment_search_finds_what_was_planted_and_little_else(spark):
    pick = random.Random(7)
    rows = []
    for i in range(6000):
        a, b, c = pick.choice("uvwx"), pick.choice(["p", "q", None]), pick.randrange(5)
        rows.append((a, b, c, int(pick.random() < (0.6 if (a, b) == ("u", "p") else 0.2)), "clash"))
    df = spark.createDataFrame(rows, "a string, `b b` string, c int, y int, n string")
    got = {r["segment"]: r for r in profile.segment_search(df, "y", ["a", "b b", "c"]).collect()}
    assert len(got) == 4 + 3 + 5 + 12 + 20 + 15 and got["a=u & b b=p"]["found"] == 1
    noise = [s for s, r in got.items() if r["found"] and "a=u" not in s and "b b=p" not in s]
    assert len(noise) <= 2 and got["b b=(none)"]["found"] == 0
    for r in got.values():
        assert r["p_value"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), abs=1e-6)
    ordered = sorted(r["p_value"] for r in got.values())
    last = max((i for i, p in enumerate(ordered, 1) if p <= 0.05 * i / len(ordered)), default=0)
    assert sum(r["found"] for r in got.values()) == last
    assert profile.segment_search(df.where("y IS NULL"), "y", ["a"]).count() == 0
