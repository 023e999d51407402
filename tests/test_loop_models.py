"""Models that every loop updates, and versions that streaks of bad forecasts bring about."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlens.operators import arima, forecast, loop_arima

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def loops(spark, values, size, job="j"):
    return spark.createDataFrame(
        [(job, i // size, at(i), None if v is None else float(v)) for i, v in enumerate(values)],
        "job string, loop long, ts timestamp, workload double",
    )


def products(values, upto):
    """Plain sum of the products of a history, as a packed upper triangle."""
    gram = np.zeros((loop_arima.SIDE, loop_arima.SIDE))
    for i in range(loop_arima.LAGS, upto):
        z = np.r_[1.0, values[i - loop_arima.LAGS : i + 1][::-1]]
        gram += np.outer(z, z)
    return gram[loop_arima.UPPER]


@pytest.mark.parametrize("block", [24, 37, 8192])
def test_states_hold_the_whole_history(spark, monkeypatch, block):
    monkeypatch.setattr(loop_arima, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    sizes = [1, 30, 2, 1, 1, 47, 5, 60, 3]
    number = [loop for loop, size in enumerate(sizes) for _ in range(size)]
    values = rng.normal(size=len(number)) * 5 + 100
    rows = [("j", 2 * loop, at(i), float(values[i])) for i, loop in enumerate(number)]
    rows += [("k", 7, at(0), 4.0), ("k", 7, at(1), None)]
    df = spark.createDataFrame(rows, "job string, loop long, ts timestamp, workload double")
    got = {(r["job"], r["loop"]): r for r in loop_arima.loop_states(df, slice_by=F.floor(F.unix_seconds("ts") / 20)).collect()}
    assert len(got) == len(sizes) + 1
    assert got["k", 7]["n"] == 1 and got["k", 7]["total"] == 0 and got["k", 7]["tail"] == [0.0]
    centred = values - values[0]
    for loop, end in enumerate(np.cumsum(sizes)):
        state = got["j", 2 * loop]
        assert (state["n"], state["ts"], state["base"]) == (end, at(int(end) - 1), values[0])
        assert state["total"] == pytest.approx(centred[:end].sum())
        assert state["tail"] == centred[max(0, end - loop_arima.LAGS - 1) : end][::-1].tolist()
        np.testing.assert_allclose(state["products"], products(centred, end), rtol=1e-9, atol=1e-7)


def plain_forecast(values, d, p, q, horizon):
    """Both regressions over a whole history, rows as they stand."""
    y = values - values[0]
    w = np.diff(y, d)
    first = loop_arima.LAGS - d  # rows that all orders can use
    long, most = arima.LONG_AR, arima.MAX_Q
    back = lambda x, t, k: x[t - k : t][::-1]
    rows = [np.r_[1, back(w, t, long)] for t in range(first, len(w))]
    phi = np.linalg.lstsq(np.array(rows), w[first:], rcond=None)[0]
    e = np.array([w[t] - phi @ np.r_[1, back(w, t, long)] if t >= long else np.nan for t in range(len(w))])
    rows = [np.r_[1, back(w, t, p), back(e, t, q)] for t in range(first, len(w))]
    beta = np.linalg.lstsq(np.array(rows), w[first:], rcond=None)[0]
    w, e = list(w), list(e)
    for _ in range(horizon):
        t = len(w)
        w.append(beta @ np.r_[1, back(np.array(w), t, p), back(np.array(e), t, q)])
        e.append(0.0)
    made = np.array(w[-horizon:])
    for k in range(d - 1, -1, -1):
        made = np.diff(y, k)[-1] + np.cumsum(made)
    return made + values[0]


@pytest.mark.parametrize("d,p,q", [(0, 2, 0), (0, 1, 1), (1, 1, 2), (2, 2, 0), (0, 0, 0)])
def test_every_loop_has_the_coefficients_of_its_history(spark, d, p, q):
    rng = np.random.default_rng(4)
    values = 300 + 40 * np.sin(np.arange(400) / 9) + rng.normal(size=400) * 5 + np.arange(400) * 0.2
    states = loop_arima.loop_states(loops(spark, values, 10))
    chosen = states.withColumns({"d": F.lit(d), "p": F.lit(p), "q": F.lit(q)}).where("loop >= 20")
    got = {r["loop"]: r for r in loop_arima.forecast_states(chosen, 12).collect()}
    assert sorted(got) == list(range(20, 40))
    for loop in (20, 27, 39):
        end = 10 * (loop + 1)
        assert got[loop]["start"] == at(end)
        np.testing.assert_allclose(got[loop]["forecast"], plain_forecast(values[:end], d, p, q, 12), rtol=1e-6)


def test_forecasts_use_the_past_alone(spark, monkeypatch):
    rng = np.random.default_rng(21)
    wave = 500 + 100 * np.sin(np.arange(640) / 7) + rng.normal(size=640) * 3

    def run(df):
        states = loop_arima.loop_states(df)
        versions = loop_arima.fleet_versions(df, states, 20)
        return versions, {r["loop"]: r for r in loop_arima.forecast_loops(states, versions, 20).collect()}

    df = loops(spark, wave, 10)
    versions, made = run(df)
    assert [(r["since"], r["cutoff"]) for r in versions.collect()] == [(8, 8)]
    assert sorted(made) == list(range(8, 64))
    # Later rows change nothing, nor does the size of the blocks.
    monkeypatch.setattr(loop_arima, "BLOCK_ROWS", 64)
    again = run(df.filter("loop < 40"))[1]
    assert sorted(again) == list(range(8, 40))
    for loop, r in again.items():
        assert r["start"] == made[loop]["start"] == at(10 * (loop + 1))
        assert r["forecast"] == pytest.approx(made[loop]["forecast"], rel=1e-6)
    known = spark.createDataFrame(list(made.values()))
    scored = {r["loop"]: r for r in forecast.wape(df, known).collect()}
    assert scored[8]["overlap"] == 0 and scored[9]["overlap"] == 10
    assert np.mean([scored[i]["wape"] for i in range(40, 64)]) < forecast.GOOD_WAPE


def test_a_changed_series_gets_a_new_model_after_fifteen_bad_loops(spark):
    rng = np.random.default_rng(7)
    calm = 1000 + rng.normal(size=520 * 5) * 10
    wild = 1000 * rng.choice([0.5, 1.5], size=40 * 5)
    df = loops(spark, np.r_[calm, wild], 5).union(loops(spark, calm, 5, "calm"))
    states = loop_arima.loop_states(df)
    versions = loop_arima.fleet_versions(df, states, 10)
    got = sorted((r["job"], r["since"], r["cutoff"]) for r in versions.collect())
    # Bad from loop 520 on; the new model, bad itself, is replaced after fifteen more.
    assert got == [("calm", 8, 8), ("j", 8, 8), ("j", 535, 534), ("j", 551, 550)]
    used = loop_arima.newest_version(states, versions).where("job = 'j'").collect()
    since = {r["loop"]: r["version"]["since"] for r in used}
    assert (since[8], since[534], since[535], since[550], since[551]) == (8, 8, 535, 535, 551)
    assert min(since) == 8


def test_rounds_end_when_no_streak_is_left(spark):
    """Versions of job a are good from loop 30 on, those of b are never bad, c has one bad loop
    too few."""
    numbers = spark.createDataFrame(
        [(job, loop) for job in "abc" for loop in range(60)], "job string, loop long"
    )
    bad = F.expr("(job = 'a' AND loop < 30) OR (job = 'c' AND loop BETWEEN 10 AND 13)")

    def score(versions):
        later = numbers.join(versions, "job").where("loop >= since")
        return later.select("job", "loop", F.lit(3).alias("overlap"), F.when(bad, 0.9).otherwise(0.01).alias("wape"))

    fitted = []

    def fit(events):
        fitted.append({r["job"] for r in events.collect()})
        return events.withColumn("name", F.concat("job", "cutoff"))

    made = loop_arima.versions_by_events(loop_arima.first_events(numbers, first=2), fit, score, after=5)
    got = sorted((r["job"], r["since"], r["cutoff"], r["name"]) for r in made.collect())
    # Scores begin one loop after a version does: 3 to 7, 9 to 13, 15 to 19, 21 to 25.
    assert got == [
        ("a", 2, 2, "a2"), ("a", 8, 7, "a7"), ("a", 14, 13, "a13"), ("a", 20, 19, "a19"), ("a", 26, 25, "a25"),
        ("b", 2, 2, "b2"), ("c", 2, 2, "c2"),
    ]
    assert fitted == [set("abc"), {"a"}, {"a"}, {"a"}, {"a"}]


def test_short_and_odd_histories(spark):
    short = loops(spark, [4, 6, 5, None, 7], 1).union(loops(spark, [None] * 20, 2, "nothing"))
    states = loop_arima.loop_states(short)
    assert sorted((r["job"], r["loop"], r["n"]) for r in states.collect()) == [
        ("j", 0, 1), ("j", 1, 2), ("j", 2, 3), ("j", 4, 4)
    ]
    chosen = states.withColumns({"d": F.lit(0), "p": F.lit(0), "q": F.lit(0)})
    got = {r["loop"]: r["forecast"] for r in loop_arima.forecast_states(chosen, 3).collect()}
    assert got == {0: [4.0] * 3, 1: [5.0] * 3, 2: [5.0] * 3, 4: [5.5] * 3}
    none = loop_arima.fleet_versions(short, states, 3)
    assert none.count() == 0 and loop_arima.forecast_loops(states, none, 3).count() == 0
    empty = loop_arima.loop_states(loops(spark, [], 1))
    assert empty.count() == 0


def test_constant_series_go_on(spark):
    df = loops(spark, [250.0] * 200, 10)
    states = loop_arima.loop_states(df)
    made = loop_arima.forecast_loops(states, loop_arima.fleet_versions(df, states, 20), 20)
    for r in made.collect():
        assert r["forecast"] == pytest.approx([250.0] * 20)


def test_recursions_cannot_explode():
    wild = np.array([1.4, 0.3])
    calm = loop_arima._stable(wild)
    assert np.abs(np.roots(np.r_[1.0, -calm])).max() == pytest.approx(loop_arima.DAMPED)
    fine = np.array([0.5, -0.2])
    assert loop_arima._stable(fine) is fine
