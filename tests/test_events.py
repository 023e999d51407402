"""Decoding, tokenising, campaigns, geodesy and vehicles on hand-made rows."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loadlens.functions import geo
from loadlens.operators import ads, series, traffic, words
from loadlens.sources import codecs, files

T0 = datetime(2024, 1, 1)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


# --- tokenisers ------------------------------------------------------------------------

CASES = [
    ("--To die, a  b. ", ["to", "die", "a", "b"], ["--To", "die,", "a", "", "b."], ["", "to", "die", "a", "b"]),
    ("a b ", ["a", "b"], ["a", "b"], ["a", "b"]),
    ("", [], [""], [""]),
    ("   ", [], [], []),
    ("...", [], ["..."], []),
    (" x", ["x"], ["", "x"], ["", "x"]),
    ("a\n", ["a"], ["a\n"], ["a"]),
]


@pytest.mark.parametrize("dialect,column", [("words", 1), ("spaces", 2), ("changelog", 3)])
def test_tokens(spark, dialect, column):
    for case in CASES:
        lines = spark.createDataFrame([(case[0],)], "l string")
        got = [r["word"] for r in words.tokens(lines, "l", dialect).collect()]
        assert got == case[column], case[0]


# --- wire formats ----------------------------------------------------------------------


def test_ad_events_good_and_bad(spark):
    lines = spark.createDataFrame(
        [
            ('{"ts":"1676900000","id":"a","et":"view"}',),
            ('{"ts":"12x","id":"a","et":"view"}',),
            ('{"id":"a","et":"view"}',),
            ("not json",),
        ],
        "value string",
    )
    good = codecs.decode_ad_events(lines).select(F.unix_seconds("ts"), "id", "et").collect()
    assert [tuple(r) for r in good] == [(1676900000, "a", "view")]
    assert codecs.rejected_ad_events(lines).count() == 3
    with pytest.raises(PySparkException):
        codecs.decode_ad_events(lines, strict=True).collect()


def test_traffic_events_statuses(spark):
    good = '{"lp":"A-B 12","pt":{"lt":52.5,"lg":13.4},"ts":1676900000000}'
    lines = spark.createDataFrame(
        [(good,), (good.replace("A-B", "A,B"),), (good.replace("52.5", "north"),), (good + ",",)],
        "value string",
    )
    rows = codecs.parse_traffic_events(lines).collect()
    assert [r["status"] for r in rows[:3]] == ["ok", "invalid", "unmapped"]
    first = codecs.decode_traffic_events(lines.limit(1)).first()
    assert (first["lp"], first["lat"], round(first["lon"], 4)) == ("A-B 12", 52.5, 13.4)
    with pytest.raises(PySparkException):
        codecs.decode_traffic_events(lines, strict=True).collect()


def test_encoders(spark):
    counts = spark.createDataFrame([("c1", 3, at(10))], "campaign_id string, ct long, window_end timestamp")
    assert codecs.encode_campaign_counts(counts).first()[0] == '{"id":"c1","ct":3,"ts":1704067210000}'
    notice = spark.createDataFrame(
        [(at(1), "B-X 1", 52.5, 13.25, 41)],
        "window_end timestamp, lp string, lat float, lon float, avg_speed int",
    )
    assert codecs.encode_traffic_notice(notice).first()[0] == (
        "{ts: 1704067201000, lp: 'B-X 1', lat: 52.500000, long: 13.250000, avgSpeed: 41}"
    )
    pair = spark.createDataFrame([("w", 2)], "word string, count long")
    assert codecs.encode_word_count(pair).first()[0] == '("w", 2)'


def test_round_trip_of_event_encoders(spark):
    rows = spark.createDataFrame([("7", "view", 52.51, 13.38, at(3))], "id string, et string, lat float, lon float, ts timestamp")
    ad = rows.select(codecs.encode_ad_event(F.col("ts"), F.col("id"), F.col("et")).alias("value"))
    assert codecs.decode_ad_events(ad).first() == (at(3), "7", "view")
    car = rows.select(
        codecs.encode_traffic_event(F.col("id"), F.col("lat"), F.col("lon"), F.col("ts")).alias("value")
    )
    back = codecs.decode_traffic_events(car).first()
    assert (back["lp"], back["ts"], round(back["lat"], 4)) == ("7", at(3), 52.51)


# --- campaigns -------------------------------------------------------------------------


def test_campaign_windows_keep_unknown_ads(spark):
    events = spark.createDataFrame(
        [("a", "view", at(1)), ("a", "view", at(9.9)), ("a", "view", at(10)), ("a", "click", at(2)), ("z", "view", at(3))],
        "id string, et string, ts timestamp",
    )
    dim = spark.createDataFrame([("a", "c1"), ("b", "c1")], "ad_id string, campaign_id string")
    rows = ads.campaign_window_counts(events, dim).collect()
    assert {(r["campaign_id"], r["ct"], r["window_end"]) for r in rows} == {
        ("c1", 2, at(10)),
        ("c1", 1, at(20)),
        ("UNKNOWN", 1, at(10)),
    }


def test_load_ad_campaigns(spark, tmp_path):
    (tmp_path / "ads.txt").write_text("".join(f"ad{i}\n" for i in range(30)))
    (tmp_path / "campaigns.txt").write_text("c0\nc1\nc2\n")
    rows = files.load_ad_campaigns(spark, str(tmp_path / "ads.txt"), str(tmp_path / "campaigns.txt")).collect()
    assert {r["ad_id"]: r["campaign_id"] for r in rows} == {f"ad{i}": f"c{i // 10}" for i in range(30)}


# --- geodesy ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def legs():
    """Legs from a metre to 10 000 km, all over the globe, date line included."""
    rng = np.random.default_rng(5)
    parts = []
    for span in (1e-5, 0.01, 0.4, 3, 60):
        lat, lon = rng.uniform(-88, 88, 400), rng.uniform(-180, 180, 400)
        to = np.clip(lat + rng.uniform(-span, span, 400), -89.9, 89.9)
        parts.append(np.c_[lat, lon, to, (lon + rng.uniform(-span, span, 400) + 180) % 360 - 180])
    return np.concatenate(parts)


def corners():
    return [F.col(c) for c in "abcd"]


def test_distance_agrees_with_vincenty_at_every_length(spark, legs):
    rows = spark.createDataFrame(pd.DataFrame(legs, columns=list("abcd")))
    got = rows.select(geo.distance(*corners()).alias("m"), geo.vincenty(*corners()).alias("v")).toPandas()
    assert (got["m"] - got["v"]).abs().max() < 0.001
    assert got["v"].max() > 8e6


def test_distance_across_the_date_line_and_of_nothing(spark):
    rows = spark.createDataFrame(
        [(0.0, 179.9, 0.0, -179.9), (10.0, 10.0, 10.0, 10.0), (0.0, 0.0, 0.0, 90.0), (90.0, 0.0, -90.0, 0.0)],
        "a double, b double, c double, d double",
    )
    got = [r[0] for r in rows.select(geo.distance(*corners())).collect()]
    assert got == pytest.approx([22263.8982, 0.0, 10018754.1714, 20003931.4586], abs=0.01)


def test_steps_lie_on_the_way(spark, legs):
    whole = geo._vincenty(*legs.T)
    part = whole * np.random.default_rng(7).uniform(0, 1, len(legs))
    rows = spark.createDataFrame(pd.DataFrame(np.c_[legs, part], columns=list("abcds")))
    lat, lon = geo.step(*corners(), F.col("s"))
    at = rows.select(lat.alias("x"), lon.alias("y")).toPandas().to_numpy()
    before = geo._vincenty(legs[:, 0], legs[:, 1], at[:, 0], at[:, 1])
    after = geo._vincenty(at[:, 0], at[:, 1], legs[:, 2], legs[:, 3])
    assert np.abs(before - part).max() < 0.12 and np.abs(before + after - whole).max() < 0.001


def test_vincenty_known_line(spark):
    # Flinders Peak to Buninyong, on GRS80 54 972.271 m; WGS84 differs below a millimetre.
    row = spark.createDataFrame(
        [(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777)], "a double, b double, c double, d double"
    )
    assert abs(row.select(geo.vincenty(*[F.col(c) for c in "abcd"])).first()[0] - 54972.271) < 0.01


def test_box_never_hides_a_near_point(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame(
        {"lat": 52.51623 + rng.uniform(-0.03, 0.03, 4000), "lon": 13.38532 + rng.uniform(-0.04, 0.04, 4000)}
    )
    points = spark.createDataFrame(pdf)
    centre = (F.lit(traffic._as_float32(52.51623)), F.lit(traffic._as_float32(13.38532)))
    near = points.filter(geo.distance(*centre, F.col("lat"), F.col("lon")) <= 1000).count()
    assert 0 < near == traffic.within_radius(points).count()


# --- vehicles --------------------------------------------------------------------------


def walk_points(spark, rows):
    return spark.createDataFrame(rows, "lp string, lat float, lon float, ts timestamp")


def test_offset_windows_and_single_points(spark):
    points = walk_points(spark, [("v", 52.5, 13.4, at(0)), ("v", 52.501, 13.4, at(1)), ("v", 52.502, 13.4, at(2))])
    rows = {r["window_end"]: r for r in traffic.avg_speed_windows(points, 1000).collect()}
    # Boundaries lie at second 1 of each ten.
    assert set(rows) == {at(1), at(11)}
    assert rows[at(1)]["avg_speed"] == 0
    # About 111 m in one second.
    # 0.001 degrees of latitude there are 111.27 m.
    assert rows[at(11)]["avg_speed"] == 400
    assert rows[at(11)]["lat"] == pytest.approx(52.502, abs=1e-5)


def test_speed_does_not_depend_on_slicing(spark):
    rng = np.random.default_rng(8)
    rows = [
        ("hot" if i % 3 else "b", float(52.5 + x), 13.4, at(float(s)))
        for i, (x, s) in enumerate(zip(rng.uniform(0, 0.01, 300), rng.uniform(0, 7200, 300)))
    ]
    points = walk_points(spark, rows)
    answers = [
        sorted(
            map(tuple, traffic.avg_speed_windows(points, 1000, "1 hour", "1 second", s).collect()), key=str
        )
        for s in (60, 3600)
    ]
    assert answers[0] == answers[1]


def test_speeding_keeps_the_limit(spark):
    rows = spark.createDataFrame([(39,), (40,), (41,)], "avg_speed int")
    assert [r[0] for r in traffic.speeding(rows).collect()] == [40, 41]


def test_densify_by_hand(spark):
    # 93 m north at 36 km/h, one point a second: 0, 10, ... 90 m; then back at half the speed.
    north = 52.5 + 93 / 111267.5
    way = spark.createDataFrame(
        [("v", 0, 52.5, 13.4, 36), ("v", 1, north, 13.4, 36), ("v", 2, north, 13.4, 36),
         ("v", 3, 52.5, 13.4, 18), ("v", 4, 52.6, 13.4, 0), ("v", 5, 52.5, 13.4, None)],
        "lp string, seq long, lat double, lon double, speed int",
    )
    rows = traffic.densify_trajectory(traffic.legs(way), 1000, F.lit(5000).cast("bigint")).orderBy("ts_ms").collect()
    # No way and no speed give no points.
    assert [r["seq"] for r in rows] == [1] * 10 + [3] * 19
    assert [r["ts_ms"] for r in rows] == [5000 + 1000 * i for i in range(29)]
    assert rows[1]["lat"] - rows[0]["lat"] == pytest.approx(10 / 111267.5, abs=8e-6)
    assert rows[11]["lat"] - rows[10]["lat"] == pytest.approx(-5 / 111267.5, abs=8e-6)


def test_blocks_of_a_long_leg_are_spread(spark):
    way = spark.createDataFrame([("v", 0, 0.0, 0.0, 1), ("v", 1, 0.0, 1.0, 36)], "lp string, seq long, lat double, lon double, speed int")
    dense = traffic.densify_trajectory(traffic.legs(way), 100, F.lit(0).cast("bigint"))
    assert dense.count() == 111320  # 111 319.49 m in steps of 1 m
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == 2 and "lp#" in plan[plan.index("Generate explode") :].split("Generate explode")[1]


def test_road_graph(spark, tmp_path):
    (tmp_path / "g.json").write_text(
        '{"nodes": [{"id": "1", "latitude": 52.5, "longitude": 13.4},\n'
        '{"id": "2", "latitude": 52.501, "longitude": 13.4}],\n'
        '"edges": [{"source": "1", "target": "2"}, {"source": "2", "target": "1"}]}'
    )
    nodes, edges = files.read_road_graph(spark, str(tmp_path / "g.json"))
    rows = traffic.road_segments(nodes, edges).collect()
    assert [round(r["metres"], 1) for r in rows] == [111.3, 111.3]


# --- curves ----------------------------------------------------------------------------


def test_curve_files(spark, tmp_path):
    curve = series.workload_curve(spark, 8, 100, 1, 5)
    assert [r["count"] for r in curve.orderBy("second").collect()] == [55, 90, 105, 90, 55, 19, 5, 19]
    files.write_curve(curve, str(tmp_path / "curve"))
    back = files.read_workload_curve(spark, str(tmp_path / "curve"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in curve.collect()}


def test_metric_file_with_mark_and_blank_line(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        '﻿"Time","pod.1","pod-2"\n"2023-01-21 20:40:00",0.5,\n"2023-01-21 20:40:15",0.25,3\n\n',
        encoding="utf-8",
    )
    rows = files.read_metric_csv(spark, str(tmp_path / "m.csv"), "cpu", "j").collect()
    assert sorted((r["pod"], r["value"]) for r in rows) == [("pod-2", 3.0), ("pod.1", 0.25), ("pod.1", 0.5)]
    files.write_metric(spark.createDataFrame(rows), "cpu", str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3


def test_resample_limits_and_missing_anchor(spark):
    rows = spark.createDataFrame([("s", at(i), i) for i in range(10)], "series string, ts timestamp, value int")
    values = lambda df: sorted(r["value"] for r in df.collect())
    assert values(series.resample(rows, 3)) == [0, 3, 6, 9]
    assert values(series.resample(rows, 3, limit=2)) == [6, 9]
    anchor = spark.createDataFrame([("s", at(7))], "series string, anchor timestamp")
    assert values(series.resample(rows, 2, anchors=anchor)) == [1, 3, 5, 7]
    missing = spark.createDataFrame([("s", at(7.5))], "series string, anchor timestamp")
    assert values(series.resample(rows, 2, anchors=missing)) == []
    assert values(series.observation_at(rows, F.lit(at(4)))) == [4]


def test_expand_splits_bursts(spark):
    curve = spark.createDataFrame([(0, 25000), (1, 0), (2, 1)], "second long, count long")
    rows = series.expand_rate_curve(curve).groupBy("second").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("i").alias("d")
    )
    assert {tuple(r) for r in rows.collect()} == {(0, 25000, 25000), (2, 1, 1)}
