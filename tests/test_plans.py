"""Physical plans stay fit for large inputs."""

import re

import pytest

from loadlens.operators import ads, traffic
from loadlens.plans import event_queries, metric_queries
from loadlens.plans import tables as t
from loadlens.plans.catalog import QUERIES

# Built lazily from the tables alone (no intermediate table is written).
NATIVE = {
    "campaign_window_counts": event_queries.campaign_window_counts,
    "avg_speed_windows": event_queries.avg_speed_windows,
    "word_count_words": QUERIES["word_count_words"],
    "avg_over_time": metric_queries.avg_over_time,
    "counter_rate": metric_queries.counter_rate,
    "metric_range": metric_queries.metric_range,
    "event_type_runs": metric_queries.event_type_runs,
    "ecdf": metric_queries.ecdf,
    "every_nth_sample": event_queries.every_nth_sample,
    "loop_frames": metric_queries.loop_frames,
}


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(NATIVE))
def test_no_single_task_and_no_python(spark, sf_dir, name):
    plan = physical(NATIVE[name](spark, sf_dir))
    for word in ("SinglePartition", "Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan, word


def test_windows_are_partitioned_by_slice(spark, sf_dir):
    plan = physical(event_queries.avg_speed_windows(spark, sf_dir))
    exchanges = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("__slice" in e for e in exchanges)


def test_scan_reads_only_what_is_asked(spark, sf_dir):
    plan = physical(ads.views(t.ad_events(t.events(spark, sf_dir))))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plan
    assert "props" not in plan and "value" not in plan


def test_box_reaches_a_stored_point_table(spark, tmp_path):
    rows = spark.createDataFrame([("v", 52.5, 13.4)], "lp string, lat float, lon float")
    rows.write.parquet(str(tmp_path / "p"))
    plan = physical(traffic.within_radius(spark.read.parquet(str(tmp_path / "p"))))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(lat", plan)


def test_counts_are_taken_before_the_join(spark, sf_dir):
    plan = physical(event_queries.campaign_window_counts(spark, sf_dir))
    assert plan.index("Join") < plan.rindex("partial_count")


def test_runs_move_their_rows_once(spark, sf_dir):
    plan = physical(metric_queries.event_type_runs(spark, sf_dir))
    by_slice = [e for e in re.findall(r"Exchange hashpartitioning\(([^)]*)\), REPARTITION", plan)]
    assert 1 <= len(by_slice) <= 2  # the second is the same exchange, read again
    assert plan.count("Exchange") <= 8
