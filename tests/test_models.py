"""Anomalies, load lines, capacities, forecasts and decisions."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadlens.operators import (
    anomaly,
    arima,
    capacity,
    forecast,
    recovery,
    regression,
    scaleout,
)
from loadlens.operators.scan import epoch, time_slice

T0 = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


# --- anomalies -------------------------------------------------------------------------


def smeared_runs(raw, gap):
    flags = [max(raw[max(0, i - gap) : i + 1]) for i in range(len(raw))]
    sums, previous = [], None
    for f in flags:
        if f != previous:
            sums.append(0)
        sums[-1] += f
        previous = f
    return flags, [s - gap for s in sums if s - gap > 0]


@pytest.mark.parametrize("seed,rate", [(1, 0.02), (2, 0.1), (3, 0.4)])
def test_anomaly_runs_by_brute_force(spark, seed, rate):
    rng = np.random.default_rng(seed)
    residual = np.where(rng.random(300) < rate, 100.0, rng.normal(size=300))
    rows = spark.createDataFrame(
        [("j", at(i), float(v)) for i, v in enumerate(residual)], "job string, ts timestamp, residual double"
    )
    moments = anomaly.residual_moments(rows)
    m = moments.first()
    assert m["std"] == pytest.approx(residual.std())
    raw = (np.abs(residual - m["mean"]) > m["std"]).astype(int).tolist()
    flags, runs = smeared_runs(raw, 6)
    got = anomaly.detect_anomalies(
        rows, moments, gap=6, slice_by=time_slice(epoch(F.col("ts")), 17)
    )
    assert [r["anomaly"] for r in got.orderBy("ts").collect()] == flags
    found = anomaly.anomaly_runs(got, gap=6, slice_rows=25).orderBy("run_pos").collect()
    assert [r["excess"] for r in found] == runs
    seen = anomaly.observed_recovery_time(got, gap=6).first()
    assert seen["recovery_time"] == pytest.approx(np.mean(runs) if runs else 0)
    assert seen["recovered"] == (flags[-1] == 0)


def test_no_anomaly_means_zero(spark):
    rows = spark.createDataFrame([("j", at(i), 1.0) for i in range(5)], "job string, ts timestamp, residual double")
    got = anomaly.observed_recovery_time(anomaly.detect_anomalies(rows, anomaly.residual_moments(rows))).first()
    assert tuple(got) == ("j", True, 0, 0.0)


def test_outer_alignment_reads_gaps_as_zero(spark):
    w = spark.createDataFrame([("j", at(0), 5.0), ("j", at(1), 7.0)], "job string, ts timestamp, workload double")
    x = spark.createDataFrame([("j", at(1), 4.0), ("j", at(2), 2.0)], "job string, ts timestamp, throughput double")
    got = anomaly.residuals(w, x).orderBy("ts").collect()
    assert [r["residual"] for r in got] == [5.0, 3.0, -2.0]


# --- load lines ------------------------------------------------------------------------


def pod_samples(seed, loops, pods=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for pod in pods:
        for loop in loops:
            for _ in range(rng.integers(1, 6)):
                x = rng.uniform(0.1, 0.9)
                rows.append(("j", pod, int(loop), x, 900 * x + rng.normal() * 20))
    return pd.DataFrame(rows, columns=["job", "pod", "loop", "cpu", "throughput"])


def folded(spark, pdf):
    moments = regression.loop_moments(spark.createDataFrame(pdf))
    lines = regression.fold_lines(regression.with_sessions(moments)).toPandas()
    return lines.set_index(["pod", "loop"]).sort_index()


def test_lines_by_hand(spark):
    """The first loop is measured from means of 0; n - 1 of n parts of each square count."""
    loops = [[(1, 2), (3, 4)], [(5, 10)], [(0, 0), (0, 2)]]
    rows = [("j", "a", i, float(x), float(y)) for i, loop in enumerate(loops) for x, y in loop]
    got = folded(spark, pd.DataFrame(rows, columns=["job", "pod", "loop", "cpu", "throughput"])).loc["a"]
    # v: 1/2 (2 + 2 * 4) = 5, + 2/3 * 9 = 11, + 4/5 * 18 = 25.4
    # c: 1/2 (2 + 2 * 6) = 7, + 2/3 * 21 = 21, + 4/5 * 26 = 41.8
    slopes = [7 / 5, 21 / 11, 41.8 / 25.4]
    means = [(2, 3), (3, 16 / 3), (1.8, 3.6)]
    assert got["slope"].tolist() == pytest.approx(slopes)
    assert got["intercept"].tolist() == pytest.approx([y - s * x for s, (x, y) in zip(slopes, means)])


def test_lines_have_the_properties_of_the_model(spark, monkeypatch):
    monkeypatch.setattr(regression, "LOOPS_PER_SLICE", 4)
    # The pod is away in loops 6 and 13: it starts again in 7 and 14.
    pdf = pod_samples(1, [i for i in range(20) if i not in (6, 13)])
    got = folded(spark, pdf)
    for pod, part in pdf.groupby("pod"):
        for first, stop in ((0, 6), (7, 13), (14, 20)):
            for loop in range(first, stop):
                seen = part[part["loop"].between(first, loop)]
                row = got.loc[(pod, loop)]
                # Means are those of all samples since the pod came back.
                assert row["n"] == len(seen)
                assert row["mean_x"] == pytest.approx(seen["cpu"].mean())
                assert row["mean_y"] == pytest.approx(seen["throughput"].mean())
                if not np.isnan(row["slope"]):
                    at_mean = row["slope"] * row["mean_x"] + row["intercept"]
                    assert at_mean == pytest.approx(row["mean_y"])
            opening = part[part["loop"] == first]
            if len(opening) > 1:  # one batch alone: a line through the origin's moments
                ratio = (opening["cpu"] * opening["throughput"]).sum() / (opening["cpu"] ** 2).sum()
                assert got.loc[(pod, first)]["slope"] == pytest.approx(ratio)
    # What came before an absence has no influence.
    later = folded(spark, pdf[pdf["loop"] >= 14])
    columns = ["n", "mean_x", "mean_y", "slope", "intercept"]
    np.testing.assert_allclose(
        later[columns].to_numpy(float), got.loc[later.index, columns].to_numpy(float), rtol=1e-9
    )


def test_batches_of_one_are_least_squares(spark):
    pdf = pod_samples(2, range(30))
    pdf["loop"] = pdf.groupby("pod").cumcount()
    df = spark.createDataFrame(pdf)
    folded = regression.fold_lines(regression.with_sessions(regression.loop_moments(df)))
    last = folded.groupBy("pod").agg(F.max_by("slope", "loop").alias("s"), F.max_by("intercept", "loop").alias("i"))
    exact = regression.least_squares_lines(df)
    for r in last.join(exact, "pod").collect():
        assert r["s"] == pytest.approx(r["slope"]) and r["i"] == pytest.approx(r["intercept"])
    score = regression.regression_score(df, exact).collect()
    for r in score:
        part = pdf[pdf["pod"] == r["pod"]]
        assert r["r2"] == pytest.approx(np.corrcoef(part["cpu"], part["throughput"])[0, 1] ** 2)


def test_unusable_loop_updates_nothing_but_keeps_models(spark):
    rows = []
    for loop in range(3):
        for i in range(4):
            for pod in ("a", "b"):
                # In loop 1 pod b reports cpu and throughput, but never together.
                split = loop == 1 and pod == "b"
                cpu = None if split and i % 2 else 0.2 + 0.1 * i + 0.05 * loop
                thr = None if split and not i % 2 else 100.0 + 90 * i
                rows.append(("j", pod, loop, at(60 * loop + i), cpu, thr))
    df = spark.createDataFrame(rows, "job string, pod string, loop long, ts timestamp, cpu double, throughput double")
    pods = capacity.loop_pods(capacity.loop_frames(df))
    got = capacity.pod_capacity(pods).orderBy("pod", "loop").collect()
    assert [(r["pod"], r["loop"]) for r in got] == [("a", 0), ("a", 2), ("b", 0), ("b", 2)]
    lines = regression.fold_lines(regression.with_sessions(pods)).filter("loop = 2").collect()
    # Loops 0 and 2 count; the model was not dropped in between.
    assert {r["n"] for r in lines} == {8}


def test_skew_uses_means_before_incomplete_samples_go(spark):
    rows = [
        ("j", "a", 0, at(0), 0.9, 100.0),
        ("j", "a", 0, at(1), 0.5, None),
        ("j", "a", 0, at(2), 0.7, 80.0),
        ("j", "b", 0, at(0), 0.3, 40.0),
        ("j", "b", 0, at(1), 0.2, 30.0),
        ("j", "b", 0, at(2), 0.4, 50.0),
        # No throughput of any pod at this time: the row is not aligned.
        ("j", "a", 0, at(3), 1.0, None),
    ]
    df = spark.createDataFrame(rows, "job string, pod string, loop long, ts timestamp, cpu double, throughput double")
    got = {r["pod"]: r for r in capacity.loop_pods(capacity.loop_frames(df)).collect()}
    assert got["a"]["max_cpu_mean"] == pytest.approx(0.7)
    assert got["a"]["mx"] == pytest.approx(0.8) and got["a"]["k"] == 2


# --- capacities ------------------------------------------------------------------------


@pytest.mark.parametrize("rows_per_block", [64, 100])
def test_observed_capacity_folds_with_truncation(spark, monkeypatch, rows_per_block):
    monkeypatch.setattr(capacity, "FOLD_ROWS", rows_per_block)
    rng = np.random.default_rng(7)
    values = rng.integers(1, 5000, 600).tolist()
    scale = rng.choice([2, 3], 600, p=[0.8, 0.2]).tolist()
    df = spark.createDataFrame(
        [("j", i, s, v) for i, (v, s) in enumerate(zip(values, scale))],
        "job string, loop long, parallelism int, capacity long",
    )
    got = {r["loop"]: r["observed"] for r in capacity.observed_capacity(df).collect()}
    state = {}
    for i, (v, s) in enumerate(zip(values, scale)):
        state[s] = int((state[s] + v) / 2) if s in state else v
        assert got[i] == state[s]


@pytest.mark.parametrize(
    "values,want",
    [
        ([800, 0, -100, 400], [800, 400, 150, 275]),
        ([0, 0, 7, 4], [0, 0, 7, 5]),
        ([-3, 2, 7], [-3, 0, 7]),
        ([None, -9, None, 4, 5], [-9, -2, 1]),
    ],
)
def test_observed_capacity_counts_every_known_value(spark, values, want):
    df = spark.createDataFrame(
        [("j", i, 2, v) for i, v in enumerate(values)] + [(None, i, 2, 8) for i in range(3)],
        "job string, loop long, parallelism int, capacity long",
    )
    got = capacity.observed_capacity(df).orderBy("loop").collect()
    assert [r["observed"] for r in got if r["job"]] == want
    assert [r["observed"] for r in got if r["job"] is None] == [8, 8, 8]


def test_simple_capacity_decays(spark, monkeypatch):
    monkeypatch.setattr(capacity, "FOLD_ROWS", 4)
    values = [100.0, 50.0, 80.0, 10.0, 60.0, 60.0]
    later = [(20, 40.0), (21, 60.0)]
    df = spark.createDataFrame(
        [("j", "a", i, True, 1.0, v) for i, v in [*enumerate(values), *later]],
        "job string, pod string, loop long, usable boolean, cpu_sum double, throughput_sum double",
    )
    got = [r["simple_capacity"] for r in capacity.simple_capacity(df).orderBy("loop").collect()]
    x, want = values[0], []
    for i, v in enumerate(values):
        x = v if i == 0 else (v + x) / 2
        want.append(x)
    # Away from loop 6 to 19: the average starts again.
    assert got == pytest.approx([*want, 40.0, 50.0])


def test_capacity_table_prefers_observations(spark):
    df = spark.createDataFrame(
        [("j", 0, 2, 1001), ("j", 1, 3, 1200), ("j", 2, 3, None)],
        "job string, loop long, parallelism int, capacity long",
    )
    rows = {r["loop"]: r["capacities"] for r in capacity.capacity_table(df, 4).collect()}
    assert rows[0] == [0, 500, 1001, 1501, 2002]
    assert rows[1] == [0, 400, 1001, 1200, 1600]
    assert rows[2] == rows[1]


# --- forecasts -------------------------------------------------------------------------


def loops(spark, values, size):
    return spark.createDataFrame(
        [("j", i // size, at(i), float(v)) for i, v in enumerate(values)],
        "job string, loop long, ts timestamp, workload double",
    )


def test_trend_continues_a_line(spark):
    df = loops(spark, [10 + 2 * i for i in range(20)], 10)
    trend = forecast.forecast_trend(df, 600)
    row = trend.filter("loop = 0").first()
    assert len(row["forecast"]) == 600 and row["start"] == at(10)
    assert row["forecast"][:3] == pytest.approx([30, 32, 34])
    scored = {r["loop"]: r for r in forecast.wape(df, trend, 1).collect()}
    assert scored[0]["overlap"] == 0 and scored[0]["wape"] == float("inf")
    assert scored[1]["overlap"] == 10 and scored[1]["wape"] == pytest.approx(0)


def test_choice_follows_accuracy(spark):
    shape = "job string, loop long, start timestamp, forecast array<double>"
    model = spark.createDataFrame([("j", i, at(0), [1.0]) for i in range(3)], shape)
    trend = spark.createDataFrame([("j", i, at(0), [2.0]) for i in range(4)], shape)
    accuracy = spark.createDataFrame(
        [("j", 0, 0.24), ("j", 1, 0.25), ("j", 2, float("inf")), ("j", 3, 0.1)], "job string, loop long, wape double"
    )
    got = {r["loop"]: r["forecast"][0] for r in forecast.choose_forecast(model, trend, accuracy).collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 2.0, 3: 2.0}


def test_streaks(spark, monkeypatch):
    monkeypatch.setattr(forecast, "LOOPS_PER_SLICE", 3)
    wapes = [0.5, 0.2, None, 0.1, 0.05, None, 0.3] + [0.9] * 15
    rows = [("j", i, 0 if w is None else 5, float("inf") if w is None else w) for i, w in enumerate(wapes)]
    df = spark.createDataFrame(rows, "job string, loop long, overlap long, wape double")
    got = forecast.bad_streaks(df).orderBy("loop").collect()
    assert [r["bad_streak"] for r in got] == [1, 2, 2, 3, 0, 0, 1] + list(range(2, 17))
    assert [r["needs_retrain"] for r in got][-3:] == [False, True, True]


def test_arima_beats_the_threshold_and_ignores_blocks(spark, monkeypatch):
    monkeypatch.setattr(arima, "BLOCK_ROWS", 200)
    rng = np.random.default_rng(1)
    t = np.arange(900)
    shapes = {
        "sine": 30000 * np.sin(2 * np.pi * t / 1800) + 35000 + rng.normal(size=900) * 50,
        "walk": 1000 + np.cumsum(rng.normal(size=900)),
        "short": 500 + rng.normal(size=900),
    }
    rows = [
        (k, at(int(i)), float(v[i])) for k, v in shapes.items() for i in t[:840] if k != "short" or i < 60
    ]
    df = spark.createDataFrame(rows, "job string, ts timestamp, workload double")
    slices = time_slice(epoch(F.col("ts")), 300)
    models = arima.fit_arima(df, slice_by=slices).toPandas()
    made = arima.forecast_arima(df, spark.createDataFrame(models), 60, slice_by=slices).toPandas()
    made = made.set_index("job")
    assert set(made.index) == {"sine", "walk", "short"}
    for job, upto in (("sine", 840), ("walk", 840), ("short", 60)):
        actual = shapes[job][upto : upto + 60]
        predicted = np.asarray(made.loc[job, "forecast"])
        assert np.abs(actual - predicted).sum() / actual.sum() < 0.25
        assert made.loc[job, "start"] == pd.Timestamp(at(upto))
    monkeypatch.setattr(arima, "BLOCK_ROWS", 65536)
    whole = arima.fit_arima(df).toPandas()
    both = models.merge(whole, on="job")
    assert (both["d_x"] == both["d_y"]).all() and (both["p_x"] == both["p_y"]).all()
    np.testing.assert_allclose(both["aic_x"], both["aic_y"], rtol=1e-6)


def test_accuracy_takes_the_whole_overlap_and_skips_missing_loops(spark):
    rows = [("j", i // 4, at(i), 10.0) for i in range(20) if i // 4 != 2]
    df = spark.createDataFrame(rows, "job string, loop long, ts timestamp, workload double")
    made = [("j", i, at(4 * i + 4), [float(8 + i)] * 12) for i in (0, 1, 3)]
    model = spark.createDataFrame(made, "job string, loop long, start timestamp, forecast array<double>")
    got = {r["loop"]: (r["overlap"], r["wape"]) for r in forecast.wape(df, model).collect()}
    # Loop 3 is scored by the forecast of loop 1, made eight steps before it.
    assert got == {0: (0, float("inf")), 1: (4, pytest.approx(0.2)), 3: (4, pytest.approx(0.1)), 4: (4, pytest.approx(0.1))}


def test_short_series_continue_their_mean_and_lags_grow(spark):
    rows = [("tiny", at(i), float(v)) for i, v in enumerate([4, 6, 5])] + [("one", at(0), 7.0)]
    df = spark.createDataFrame(rows, "job string, ts timestamp, workload double")
    models = arima.fit_arima(df)
    got = {r["job"]: r["forecast"] for r in arima.forecast_arima(df, models, 4).collect()}
    assert got == {"tiny": pytest.approx([5.0] * 4), "one": pytest.approx([7.0] * 4)}
    assert arima._kpss_lags(10**6) == 230 and arima._adf_lags(10**6 + 2) == 100


def test_moments_before_each_loop(spark):
    values = [[1.0, 3.0], [100.0], [2.0, None], [5.0]]
    rows = [("j", n, at(60 * n + i), v) for n, loop in enumerate(values) for i, v in enumerate(loop)]
    df = spark.createDataFrame(rows, "job string, loop long, ts timestamp, residual double")
    got = anomaly.moments_before(df).orderBy("loop").collect()
    for r in got:
        seen = [v for loop in values[: r["loop"]] for v in loop if v is not None]
        assert r["n"] == len(seen)
        if seen:
            assert (r["mean"], r["std"]) == (pytest.approx(np.mean(seen)), pytest.approx(np.std(seen)))
        else:
            assert r["mean"] is None and r["std"] is None
    flagged = anomaly.detect_anomalies(df, anomaly.moments_before(df), gap=0, as_of=("loop",))
    # 100 lies far from the two values before it; 2 is ordinary once 100 has been seen.
    assert [r["raw"] for r in flagged.orderBy("ts").collect()] == [0, 0, 1, 0, 0, 0]


# --- recovery and decisions ------------------------------------------------------------

SITUATION = (
    "job string, loop long, parallelism int, capacities array<bigint>, forecast array<double>, "
    "avg_workload bigint, tail_workload double, lag double, since_rescale bigint"
)


def situation(spark, **changes):
    row = {
        "job": "j", "loop": 0, "parallelism": 1, "capacities": [0, 600, 1200, 1800, 2400],
        "forecast": [1000.0] * 900, "avg_workload": 1000, "tail_workload": 10000.0, "lag": 0.0,
        "since_rescale": 1000, **changes,
    }
    return spark.createDataFrame([tuple(row.values())], SITUATION)


def test_recovery_by_hand(spark):
    got = {r["scaleout"]: r["recovery_time"] for r in recovery.predict_recovery(situation(spark)).collect()}
    assert got == {0: None, 1: 10830, 2: 260, 3: 110, 4: 88}
    late = recovery.predict_recovery(situation(spark, lag=200000.0)).collect()
    assert {r["scaleout"]: r["recovery_time"] for r in late if r["scaleout"] in (2, 3)} == {2: 10830, 3: 360}
    down = recovery.predict_recovery(situation(spark, parallelism=4)).collect()
    # Scaling down restarts faster: 25 000 behind, 800 spare from step 15 on.
    assert [r["recovery_time"] for r in down if r["scaleout"] == 3] == [15 + 31 + 15]


def test_recovery_never_rises_with_capacity(spark):
    got = recovery.predict_recovery(situation(spark, capacities=[0, 600, *range(1050, 3000, 150)]))
    times = [r["recovery_time"] for r in got.orderBy("scaleout").collect()][1:]
    assert times == sorted(times, reverse=True)


@pytest.mark.parametrize(
    "changes,target,reason",
    [
        ({}, 2, "fits"),
        ({"lag": 200000.0}, 3, "fits"),
        ({"since_rescale": 179}, 1, "stabilising"),
        ({"capacities": [0, 0, 0, 0, 0]}, 1, "capacity unknown"),
        ({"parallelism": 3, "since_rescale": 500}, 3, "calm period"),
        ({"parallelism": 3, "since_rescale": 600}, 2, "fits"),
        ({"parallelism": 3, "lag": 5000.0}, 3, "fits"),
        ({"forecast": [1000.0] * 600 + [2000.0] * 300}, 4, "fits"),
        ({"avg_workload": 5000}, 4, "maximum"),
    ],
)
def test_decisions(spark, changes, target, reason):
    row = scaleout.plan_scaleout(situation(spark, **changes)).first()
    assert (row["target"], row["reason"]) == (target, reason)


def test_target_is_the_smallest_candidate_that_meets_every_condition(spark):
    rng = np.random.default_rng(11)
    cases = []
    for n in range(60):
        level = float(rng.integers(200, 2500))
        cases.append(
            {
                "job": f"j{n}", "loop": n, "parallelism": int(rng.integers(1, 7)),
                "capacities": [0, *np.cumsum(rng.integers(100, 700, 6)).tolist()],
                "forecast": (level + rng.normal(size=700).cumsum() * 5).tolist(),
                "avg_workload": int(level * rng.uniform(0.8, 1.1)),
                "tail_workload": 10 * level, "lag": float(rng.choice([0, 3000, 60000])),
                "since_rescale": int(rng.choice([60, 300, 900])),
            }
        )
    df = spark.createDataFrame([tuple(c.values()) for c in cases], SITUATION)
    planned = {r["loop"]: r for r in scaleout.plan_scaleout(df).collect()}
    facts = pd.DataFrame(cases).set_index("loop")
    # Recovery times are checked by hand above.
    options = recovery.predict_recovery(df).toPandas().join(
        facts.drop(columns=["job", "parallelism"]), on="loop"
    )
    options["now"] = [c[p] for c, p in zip(options["capacities"], options["parallelism"])]
    options["peak"] = options["forecast"].map(max)
    options["peak_until"] = [
        max(f[: int(r)]) if r == r else np.inf for f, r in zip(options["forecast"], options["recovery_time"])
    ]
    same = options["scaleout"] == options["parallelism"]
    shrinks = (options["scaleout"] < options["parallelism"]) & (options["now"] < options["lag"])
    fits = options[
        (options["capacity"] > options["avg_workload"])
        & (options["recovery_time"] <= 600)
        & (options["capacity"] >= options["peak_until"])
        & (same | (~shrinks & (options["capacity"] > options["peak"])))
    ]
    smallest = fits.groupby("loop")["scaleout"].min()
    reasons = set()
    for loop, row in planned.items():
        reasons.add(row["reason"])
        if row["reason"] == "fits":
            assert row["target"] == smallest[loop]
        elif row["reason"] == "maximum":
            assert loop not in smallest.index and row["target"] == 6
        else:
            assert row["target"] == facts.loc[loop, "parallelism"]
            age = facts.loc[loop, "since_rescale"]
            assert age < 180 if row["reason"] == "stabilising" else 180 <= age < 600
    assert {"fits", "maximum", "stabilising", "calm period"} <= reasons


def test_every_situation_gets_a_decision(spark):
    for forecast_ in ([], [None] * 10):
        row = scaleout.plan_scaleout(situation(spark, parallelism=3, forecast=forecast_)).first()
        assert (row["target"], row["reason"]) == (3, "no forecast")
        times = recovery.predict_recovery(situation(spark, forecast=forecast_)).collect()
        assert all(r["recovery_time"] is None for r in times)


def test_time_since_rescale(spark):
    df = spark.createDataFrame(
        [("j", i, p) for i, p in enumerate([2, 2, 3, 3, 2])], "job string, loop long, parallelism int"
    )
    got = scaleout.since_last_rescale(df, 60, slice_loops=2).orderBy("loop").collect()
    assert [r["since_rescale"] for r in got] == [300, 360, 0, 60, 0]


def test_downtimes_move_by_direction(spark):
    df = spark.createDataFrame(
        [("j", 0, "up", 50, 40), ("j", 1, "down", 10, 40), ("j", 2, "up", 40, 40), ("j", 3, "up", 41, 40)],
        "job string, loop long, direction string, observed int, predicted int",
    )
    got = {r["loop"]: r["downtime"] for r in recovery.adjust_downtime(df).collect()}
    assert got == {0: 31, 1: 14, 2: 30, 3: 31}
