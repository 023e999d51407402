"""Queries on metric samples: selection, alignment, aggregates, values over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens import session
from loadlens.operators import capacity, report, telemetry
from loadlens.operators.scan import epoch, run_starts, time_slice
from loadlens.plans import tables as t
from loadlens.plans.registry import query
from loadlens.plans.tables import with_tables
from loadlens.sources import files

POD_NAMES = [f"pod-{i}" for i in range(t.PODS)]
HOURS, JOB_HOURS, SAMPLES = "pod_hours", "pod_hours job_hours", "pod_hours samples"


def hours(spark: SparkSession, sf: str) -> DataFrame:
    return t.pod_hours(t.events(spark, sf))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return t.samples(hours(spark, sf))


def job_hours(spark: SparkSession, sf: str) -> DataFrame:
    return t.job_hours(hours(spark, sf))


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    """`ts` as whole seconds, then the named columns; doubles to six digits."""
    doubles = {f.name for f in df.schema if f.dataType.simpleString() == "double"}
    return df.select(
        *[
            F.unix_seconds("ts").alias("ts") if c == "ts"
            else F.round(c, 6).alias(c) if c in doubles
            else F.col(c)
            for c in columns
        ]
    )


TS = "CAST(epoch(ts) AS BIGINT) AS ts"


# --- selection and alignment -----------------------------------------------------------


@query(
    "select_series",
    with_tables(
        SAMPLES,
        f""" SELECT job, pod, {TS}, round(value, 6) AS value FROM samples
             WHERE metric = 'cpu' AND regexp_full_match(pod, 'pod-[0-2]')""",
    ),
)
def select_series(spark: SparkSession, sf: str) -> DataFrame:
    chosen = telemetry.select_series(samples(spark, sf), {"metric": "cpu"}, {"pod": "pod-[0-2]"})
    return stamped(chosen, "job", "pod", "ts", "value")


@query(
    "drop_warm_up",
    with_tables(
        JOB_HOURS,
        f""" SELECT job, pod, {TS} FROM pod_hours h
             JOIN (SELECT job, min(ts) AS first FROM job_hours GROUP BY 1) USING (job)
             WHERE epoch(ts) - epoch(first) >= 3 * 3600""",
    ),
)
def drop_warm_up(spark: SparkSession, sf: str) -> DataFrame:
    rows = hours(spark, sf)
    kept = telemetry.drop_warm_up(rows, t.uptime(t.job_hours(rows)), 3 * 3600 * 1000)
    return stamped(kept, "job", "pod", "ts")


LOOP_FRAMES = """
    loop_frames AS (
        SELECT * FROM (
            SELECT job, pod, loop, ts, cpu, throughput,
                   count(cpu) OVER (PARTITION BY job, loop, ts) AS ct,
                   count(throughput) OVER (PARTITION BY job, loop, ts) AS tt,
                   count(cpu) OVER (PARTITION BY job, loop, pod) AS cp,
                   count(throughput) OVER (PARTITION BY job, loop, pod) AS tp
            FROM pod_hours
            WHERE ts >= (SELECT min(j.ts) FROM job_hours j WHERE j.job = pod_hours.job)
                        + INTERVAL 1 HOUR
        ) WHERE ct > 0 AND tt > 0 AND cp > 0 AND tp > 0
    )"""


@query(
    "loop_frames",
    with_tables(
        JOB_HOURS,
        f""", {LOOP_FRAMES} SELECT job, pod, loop, {TS}, round(cpu, 6) AS cpu, throughput
              FROM loop_frames""",
    ),
)
def loop_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = hours(spark, sf)
    frames = capacity.loop_frames(rows, t.uptime(t.job_hours(rows)))
    return stamped(frames, "job", "pod", "loop", "ts", "cpu", "throughput")


@query(
    "fill_gaps",
    with_tables(
        HOURS, f" SELECT job, pod, {TS}, round(coalesce(cpu, 0), 6) AS cpu FROM pod_hours"
    ),
)
def fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(telemetry.fill_gaps(hours(spark, sf), "cpu"), "job", "pod", "ts", "cpu")


@query(
    "metrics_wide",
    with_tables(
        SAMPLES,
        f" SELECT job, {TS}, "
        + ", ".join(f"max(value) FILTER (WHERE pod = '{p}') AS \"{p}\"" for p in POD_NAMES)
        + " FROM samples WHERE metric = 'throughput' GROUP BY ALL",
    ),
)
def metrics_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = telemetry.metrics_wide(samples(spark, sf), "throughput", POD_NAMES)
    return wide.withColumn("ts", F.unix_seconds("ts"))


@query(
    "metrics_long",
    with_tables(
        SAMPLES,
        f" SELECT job, pod, metric, {TS}, round(value, 6) AS value FROM samples WHERE metric = 'cpu'",
    ),
)
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = telemetry.metrics_wide(samples(spark, sf), "cpu", POD_NAMES)
    long = telemetry.metrics_long(wide, ["job", "ts"], "cpu")
    return stamped(long, "job", "pod", "metric", "ts", "value")


FLEET_PODS = [f"job-{j}/{p}" for j in range(t.JOBS) for p in POD_NAMES]


@query(
    "metric_csv_file",
    with_tables(
        SAMPLES,
        f""" SELECT 'fleet' AS job, job || '/' || pod AS pod, metric, {TS}, round(value, 6) AS value
             FROM samples WHERE metric = 'cpu'""",
    ),
)
def metric_csv_file(spark: SparkSession, sf: str) -> DataFrame:
    """One wide file of the whole fleet's cpu, written and read back as samples."""
    named = samples(spark, sf).withColumn("pod", F.concat_ws("/", "job", "pod")).withColumn("job", F.lit("fleet"))
    wide = telemetry.metrics_wide(named, "cpu", FLEET_PODS).drop("job")
    path = session.shared_dir(spark, "metric-csv")
    wide.withColumnRenamed("ts", "Time").write.option("header", True).csv(path)
    long = files.read_metric_csv(spark, path, "cpu", "fleet")
    return stamped(long, "job", "pod", "metric", "ts", "value")


@query(
    "metric_dump_file",
    with_tables(SAMPLES, f" SELECT job, pod, metric, {TS}, round(value, 6) AS value FROM samples WHERE metric = 'lag'"),
)
def metric_dump_file(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of one metric dumped as delimited text and read back."""
    rows = samples(spark, sf)
    path = session.shared_dir(spark, "metric-dump")
    files.write_metric(rows, "lag", path)
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    return stamped(back, "job", "pod", "metric", "ts", "value")


# A grid finer than the samples, from the first one to where the last one is too old.
STEP, LOOKBACK = 1800, 7200


@query(
    "metric_range",
    with_tables(
        SAMPLES,
        f""", grid AS (
                SELECT job, pod, metric, unnest(generate_series(
                    (SELECT CAST(epoch(min(ts)) AS BIGINT) FROM samples),
                    (SELECT CAST(epoch(max(ts)) AS BIGINT) FROM samples) + {LOOKBACK}, {STEP})) AS t
                FROM (SELECT DISTINCT job, pod, metric FROM samples)),
              points AS (SELECT job, pod, metric, CAST(epoch(ts) AS BIGINT) AS s, value FROM samples)
            SELECT g.job, g.pod, g.metric, g.t AS ts, round(p.value, 6) AS value
            FROM grid g ASOF JOIN points p
              ON g.job = p.job AND g.pod = p.pod AND g.metric = p.metric AND g.t >= p.s
            WHERE g.t - p.s <= {LOOKBACK}""",
    ),
)
def metric_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf)
    first, last = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    grid = telemetry.metric_range(rows, first or 0, (last or 0) + LOOKBACK, STEP, LOOKBACK, 86400)
    return stamped(grid, "job", "pod", "metric", "ts", "value")


@query(
    "align_inner",
    with_tables(
        SAMPLES,
        f""" SELECT job, pod, {TS}, round(c.value, 6) AS cpu, t.value AS throughput
             FROM (SELECT * FROM samples WHERE metric = 'cpu') c
             JOIN (SELECT * FROM samples WHERE metric = 'throughput') t USING (job, pod, ts)""",
    ),
)
def align_inner(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf)

    def one(metric: str) -> DataFrame:
        return telemetry.select_series(rows, {"metric": metric}).select(
            "job", "pod", "ts", F.col("value").alias(metric)
        )

    both = telemetry.align_inner(one("cpu"), one("throughput"))
    return stamped(both, "job", "pod", "ts", "cpu", "throughput")


@query(
    "align_outer",
    with_tables(
        SAMPLES,
        f""" SELECT job, pod, {TS}, round(coalesce(c.value, 0), 6) AS cpu,
                    coalesce(t.value, 0) AS lag
             FROM (SELECT * FROM samples WHERE metric = 'cpu') c
             FULL JOIN (SELECT * FROM samples WHERE metric = 'lag') t
             USING (job, pod, ts)""",
    ),
)
def align_outer(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf)
    cpu = rows.filter("metric = 'cpu'").select("job", "pod", "ts", F.col("value").alias("cpu"))
    lag = rows.filter("metric = 'lag'").select("job", "pod", "ts", F.col("value").alias("lag"))
    both = telemetry.align_outer(cpu, lag, ["cpu", "lag"], ["job", "pod", "ts"])
    return stamped(both, "job", "pod", "ts", "cpu", "lag")


# --- aggregates ------------------------------------------------------------------------


def _aggregate(name: str, metric: str, how: str, by: list[str]) -> None:
    labels = ", ".join(TS if b == "ts" else b for b in by)
    sql = with_tables(
        SAMPLES,
        f""" SELECT {labels}, round({how}(value), 6) AS value FROM samples
             WHERE metric = '{metric}' GROUP BY ALL""",
    )

    @query(name, sql)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        chosen = telemetry.select_series(samples(spark, sf), {"metric": metric})
        return stamped(telemetry.aggregate_by(chosen, how, by), *by, "value")


_aggregate("throughput_by_pod", "throughput", "sum", ["job", "pod"])
_aggregate("total_throughput", "throughput", "sum", ["job", "ts"])
_aggregate("mean_lag_by_pod", "lag", "avg", ["job", "pod"])
_aggregate("mean_lag", "lag", "avg", ["job", "ts"])
_aggregate("min_cpu", "cpu", "min", ["job", "ts"])


@query(
    "parallelism_by_job",
    with_tables(JOB_HOURS, f" SELECT job, {TS}, CAST(alive AS DOUBLE) AS value FROM job_hours"),
)
def parallelism_by_job(spark: SparkSession, sf: str) -> DataFrame:
    alive = hours(spark, sf).withColumn("value", F.lit(1.0))
    return stamped(telemetry.aggregate_by(alive, "sum", ["job", "ts"]), "job", "ts", "value")


@query(
    "consumer_lag",
    with_tables(
        SAMPLES,
        f""" SELECT job, {TS}, sum(value) AS value FROM samples
             WHERE metric = 'lag' AND value > 0 GROUP BY ALL""",
    ),
)
def consumer_lag(spark: SparkSession, sf: str) -> DataFrame:
    lag = telemetry.select_series(samples(spark, sf), {"metric": "lag"})
    return stamped(telemetry.positive_sum(lag, ["job", "ts"]), "job", "ts", "value")


@query(
    "latest_value",
    with_tables(
        SAMPLES,
        """ SELECT job, pod, metric, round(max_by(value, ts), 6) AS value FROM samples
            GROUP BY ALL""",
    ),
)
def latest_value(spark: SparkSession, sf: str) -> DataFrame:
    newest = telemetry.latest_value(samples(spark, sf), ["job", "pod", "metric"])
    return newest.withColumn("value", F.round("value", 6))


@query(
    "loop_workload",
    with_tables(
        "pod_hours job_hours loop_facts",
        " SELECT job, loop, max_workload, avg_workload, min_workload FROM loop_facts",
    ),
)
def loop_workload(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.loop_workload(job_hours(spark, sf))


@query(
    "loop_tails",
    with_tables(
        "pod_hours job_hours loop_facts",
        " SELECT job, loop, tail_workload, lag, parallelism FROM loop_facts",
    ),
)
def loop_tails(spark: SparkSession, sf: str) -> DataFrame:
    return t.loop_facts(job_hours(spark, sf)).select(
        "job", "loop", "tail_workload", "lag", "parallelism"
    )


@query(
    "tail_sum",
    """SELECT user_id, round(sum(value), 4) AS tail_sum FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events)
       WHERE r <= 10 GROUP BY 1""",
)
def tail_sum(spark: SparkSession, sf: str) -> DataFrame:
    tails = telemetry.tail_sum(t.events(spark, sf), "value", 10, ["user_id"])
    return tails.withColumn("tail_sum", F.round("tail_sum", 4))


# --- values over time ------------------------------------------------------------------


@query(
    "avg_over_time",
    """SELECT event_id, round(avg(value) OVER (
         PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW), 8)
         AS avg_value
       FROM events""",
)
def avg_over_time(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.events(spark, sf).select("event_id", "user_id", "ts", "value")
    out = telemetry.avg_over_time(rows, 43200, keys=["user_id"], slice_seconds=86400)
    return out.select("event_id", F.round("avg_value", 8).alias("avg_value"))


@query(
    "counter_rate",
    """SELECT event_id, round((sum(inc) OVER f - first_value(inc) OVER f)
                        / nullif((us - min(us) OVER f) / 1000000.0::DOUBLE, 0), 8) AS rate
       FROM (SELECT *, epoch_us(ts) AS us,
                    coalesce(CASE WHEN value < lag(value) OVER w THEN value
                                  ELSE value - lag(value) OVER w END, 0) AS inc
             FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
       WINDOW f AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""",
)
def counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.events(spark, sf).select("event_id", "user_id", "ts", "value")
    out = telemetry.counter_rate(rows, 86400, keys=["user_id"], slice_seconds=86400)
    return out.select("event_id", F.round("rate", 8).alias("rate"))


@query(
    "few_pods_alert",
    with_tables(
        JOB_HOURS,
        """ SELECT job, CAST(epoch(min(ts)) AS BIGINT) AS since, CAST(epoch(max(ts)) AS BIGINT) AS until
            FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY ts)
                            - row_number() OVER (PARTITION BY job, alive < 6 ORDER BY ts) AS run
                  FROM job_hours)
            WHERE alive < 6 GROUP BY job, run HAVING max(ts) - min(ts) >= INTERVAL 2 HOUR""",
    ),
)
def few_pods_alert(spark: SparkSession, sf: str) -> DataFrame:
    alive = telemetry.select_series(samples(spark, sf), {"metric": "throughput"})
    alerts = telemetry.few_series_alert(alive, t.PODS, 2 * t.HOUR)
    return alerts.select(
        "job", F.unix_seconds("since").alias("since"), F.unix_seconds("until").alias("until")
    )


@query(
    "event_type_runs",
    """SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_event
       FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts)
                       - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS run
             FROM events)
       GROUP BY user_id, event_type, run""",
)
def event_type_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.events(spark, sf).select("user_id", "event_type", "event_id", "ts")
    slices = time_slice(epoch(F.col("ts")), 86400)
    runs = run_starts(rows, ["user_id"], ["ts", "event_id"], slices, F.col("event_type"))
    return runs.groupBy("user_id", "event_type", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")
    ).drop("run")


# --- reports ---------------------------------------------------------------------------


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    return t.events(spark, sf).select(
        F.col("event_type").alias("approach"), F.col("value").alias("latency")
    )


@query(
    "ecdf",
    """SELECT event_type AS approach, value AS latency,
              round((row_number() OVER (PARTITION BY event_type ORDER BY value) - 1)
                    / count(*) OVER (PARTITION BY event_type), 9) AS y
       FROM events""",
)
def ecdf(spark: SparkSession, sf: str) -> DataFrame:
    return report.ecdf(_latencies(spark, sf), "latency").withColumn("y", F.round("y", 9))


@query(
    "ecdf_steps",
    """SELECT event_type AS approach, value AS latency, count(*) AS n,
              CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY value) - count(*) AS BIGINT) AS first,
              CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS total
       FROM events GROUP BY 1, 2""",
)
def ecdf_steps(spark: SparkSession, sf: str) -> DataFrame:
    return report.ecdf_steps(_latencies(spark, sf), "latency")


@query(
    "approach_means",
    """SELECT event_type AS approach, round(avg(value) / 12, 6) AS mean_latency
       FROM events GROUP BY 1""",
)
def approach_means(spark: SparkSession, sf: str) -> DataFrame:
    means = report.approach_means(_latencies(spark, sf), "latency", 12)
    return means.withColumn("mean_latency", F.round("mean_latency", 6))


@query(
    "approach_report",
    with_tables(
        HOURS,
        """, cells AS (
               SELECT ts, pod, sum(lag) AS latency, count(*) AS parallelism
               FROM pod_hours GROUP BY 1, 2),
             means AS (
               SELECT pod AS approach,
                      sum(latency) / (SELECT count(DISTINCT ts) FROM cells) AS mean_latency,
                      avg(parallelism) AS mean_parallelism
               FROM cells GROUP BY 1)
           SELECT approach, round(mean_latency, 6) AS mean_latency,
                  round(mean_parallelism, 6) AS mean_parallelism,
                  round(mean_parallelism / 12, 6) AS resource_usage
           FROM means""",
    ),
)
def approach_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = hours(spark, sf)
    grouped = rows.groupBy("ts").pivot("pod", POD_NAMES)
    out = report.approach_report(grouped.agg(F.sum("lag")), grouped.agg(F.count(F.lit(1))))
    return out.select(
        "approach", *[F.round(c, 6).alias(c) for c in out.columns if c != "approach"]
    )
