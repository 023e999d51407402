"""Samples: alignment, gaps, values over time, quantiles, reports."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loadlens.operators import report, telemetry
from loadlens.operators.scan import epoch, time_slice

T0 = datetime(2024, 1, 1)
LONG = "job string, pod string, metric string, ts timestamp, value double"


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def samples(spark, rows):
    return spark.createDataFrame([("j", "p", "m", at(s), float(v)) for s, v in rows], LONG)


def test_label_patterns_are_anchored(spark):
    rows = spark.createDataFrame([("0_1",), ("10_1",), ("0_",)], "task string")
    assert telemetry.select_series(rows, regex={"task": "0_.*"}).count() == 2


def test_warm_up_rows_go_and_unknown_times_stay(spark):
    rows = spark.createDataFrame([("j", at(0)), ("j", at(1)), ("j", at(2))], "job string, ts timestamp")
    uptime = spark.createDataFrame([("j", at(0), 119999), ("j", at(1), 120000)], "job string, ts timestamp, uptime long")
    assert [r["ts"] for r in telemetry.drop_warm_up(rows, uptime).orderBy("ts").collect()] == [at(1), at(2)]


def test_range_grid_by_brute_force(spark):
    rng = np.random.default_rng(3)
    times = np.sort(rng.choice(2000, 60, replace=False))
    rows = [(int(s), i) for i, s in enumerate(times)]
    start = 1704067200
    got = telemetry.metric_range(samples(spark, rows), start, start + 2000, 7, 30, slice_seconds=100)
    have = {int((r["ts"] - T0).total_seconds()): r["value"] for r in got.collect()}
    want = {}
    for g in range(0, 2001, 7):
        before = [(s, v) for s, v in rows if s <= g]
        if before and g - before[-1][0] <= 30:
            want[g] = float(before[-1][1])
    assert have == want


def test_rate_restarts_at_zero(spark):
    rows = samples(spark, [(0, 10), (30, 40), (60, 5), (90, 35), (500, 50)])
    got = telemetry.counter_rate(rows, 60, slice_seconds=60).orderBy("ts").collect()
    assert got[0]["rate"] is None and got[4]["rate"] is None
    assert [round(r["rate"], 6) for r in got[1:4]] == [1.0, round(35 / 60, 6), round(35 / 60, 6)]


def test_average_over_time_edge(spark):
    rows = samples(spark, [(0, 1), (60, 3), (120, 8)])
    closed = telemetry.avg_over_time(rows, 60, slice_seconds=60).orderBy("ts").collect()
    half = telemetry.avg_over_time(rows, 60, False, slice_seconds=60).orderBy("ts").collect()
    assert [r["avg_value"] for r in closed] == [1.0, 2.0, 5.5]
    assert [r["avg_value"] for r in half] == [1.0, 3.0, 8.0]


def test_odd_values_have_no_effect_out_of_reach(spark):
    nan, inf = float("nan"), float("inf")
    values = [1.0, nan, 3.0, 4.0, 1e17, 1.0, inf, 2.0, None, 5.0]
    rows = spark.createDataFrame([("j", "p", "m", at(100 * i), v) for i, v in enumerate(values)], LONG)
    got = [r["avg_value"] for r in telemetry.avg_over_time(rows, 60).orderBy("ts").collect()]
    assert [repr(x) for x in got] == [repr(x) for x in values]
    near = [r["avg_value"] for r in telemetry.avg_over_time(rows, 100).orderBy("ts").collect()]
    assert near[3] == 3.5 and near[9] == 5.0 and np.isnan(near[2])


def test_rate_forgets_odd_values(spark):
    nan = float("nan")
    values = [0.0, 10.0, nan, 30.0, 40.0, 50.0, 1e17, 5.0, 15.0]
    rows = spark.createDataFrame([("j", "p", "m", at(10 * i), v) for i, v in enumerate(values)], LONG)
    got = [r["rate"] for r in telemetry.counter_rate(rows, 10).orderBy("ts").collect()]
    assert got[0] is None and got[1] == 1.0 and np.isnan(got[3])
    assert got[4:6] == [1.0, 1.0] and got[7:] == [0.5, 1.0]


def test_alert_needs_duration(spark):
    pods = [(s, p) for s in range(0, 300, 10) for p in ("a", "b")]
    alone = {(s, "b") for s in range(50, 80, 10)} | {(s, "b") for s in range(150, 220, 10)}
    rows = spark.createDataFrame(
        [("j", p, "m", at(s), 1.0) for s, p in pods if (s, p) not in alone], LONG
    )
    alerts = telemetry.few_series_alert(rows, 2, 60, slice_seconds=40).collect()
    assert [(r["since"], r["until"]) for r in alerts] == [(at(150), at(210))]


def test_quantile_blocks(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"task": 1, "id": range(700), "lag_ms": rng.gamma(2, 50, 700)})
    pdf["ts"] = [at(i * 0.5) for i in range(700)]
    got = telemetry.lag_quantile(
        spark.createDataFrame(pdf), ["task"], ["ts", "id"], time_slice(epoch(F.col("ts")), 60),
        samples=50, block_rows=64,
    ).toPandas().sort_values("id")
    lag = pdf["lag_ms"].to_numpy()
    want = [np.quantile(lag[max(0, i - 49) : i + 1], 0.95) for i in range(700)]
    np.testing.assert_allclose(got["lag_quantile"].to_numpy(), want)


def test_lag_against_the_clock(spark):
    row = telemetry.event_time_lag(spark.range(1), F.current_timestamp()).first()
    assert row["lag_ms"] == 0


def test_wide_and_back(spark):
    rows = spark.createDataFrame(
        [("j", "a", "cpu", at(0), 0.5), ("j", "b", "cpu", at(1), 0.7), ("j", None, "cpu", at(1), 0.9)], LONG
    )
    wide = telemetry.metrics_wide(rows, "cpu")
    assert wide.columns == ["job", "ts", "a", "b", "cpu"]
    assert telemetry.metrics_long(wide, ["job", "ts"], "cpu").count() == 3


def test_ecdf_of_a_shared_value(spark):
    rows = spark.createDataFrame([("x", 0.0)] * 25000 + [("x", 5.0), ("x", -2.0)], "approach string, latency double")
    steps = report.ecdf_steps(rows, "latency").orderBy("latency").collect()
    assert [(r["latency"], r["n"], r["first"]) for r in steps] == [(-2.0, 1, 0), (0.0, 25000, 1), (5.0, 1, 25001)]
    full = report.ecdf(rows, "latency").toPandas()
    np.testing.assert_allclose(np.sort(full["y"]), np.arange(25002) / 25002)


def test_ecdf_orders_odd_values(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([("a", v) for v in (2.0, nan, -1.0, inf, 1.0, -inf, None)], "approach string, latency double")
    got = {repr(r["latency"]): r["first"] for r in report.ecdf_steps(rows, "latency").collect()}
    assert got == {"None": 0, "-inf": 1, "-1.0": 2, "1.0": 3, "2.0": 4, "inf": 5, "nan": 6}


def test_report_counts_missing_latency_as_zero(spark):
    latency = spark.createDataFrame([(1, 4.0, None), (2, 6.0, 8.0)], "ts int, a double, b double")
    scale = spark.createDataFrame([(1, 6.0, 3.0), (2, 12.0, 3.0)], "ts int, a double, b double")
    rows = {r["approach"]: r for r in report.approach_report(latency, scale).collect()}
    assert (rows["a"]["mean_latency"], rows["b"]["mean_latency"]) == (5.0, 4.0)
    assert rows["a"]["resource_usage"] == 0.75
