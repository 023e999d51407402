"""Queries on derived models: anomalies, load lines, capacity, forecasts, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens import session
from loadlens.operators import (
    anomaly,
    arima,
    capacity,
    forecast,
    loop_arima,
    recovery,
    regression,
)
from loadlens.operators.scan import running
from loadlens.plans import fleet
from loadlens.plans import tables as t
from loadlens.plans.metric_queries import LOOP_FRAMES, stamped
from loadlens.plans.registry import query
from loadlens.plans.tables import with_tables
from loadlens.sources import streams
from loadlens.streaming import jobs, online, sinks

GAP = 5
SET = fleet.HOURLY
JOB_HOURS = "pod_hours job_hours"


def _rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: F.round(c, special.get(c, digits)) for c in doubles})


# --- residual anomalies ----------------------------------------------------------------

RESIDUALS = """
    residuals AS (
        SELECT job, coalesce(w.ts, x.ts) AS ts, coalesce(w.workload, 0) - coalesce(x.throughput, 0) AS residual
        FROM job_hours w
        FULL JOIN (SELECT job, ts, throughput FROM job_hours WHERE throughput > 0) x USING (job, ts)
    )"""
FLAGGED = f"""{RESIDUALS},
    moments AS (
        SELECT job, count(residual) AS n, avg(residual) AS mean, stddev_pop(residual) AS std
        FROM residuals GROUP BY 1),
    raws AS (
        SELECT job, ts, CAST(abs(residual - mean) > std AS INTEGER) AS raw
        FROM residuals JOIN moments USING (job)),
    flagged AS (
        SELECT *, max(raw) OVER (PARTITION BY job ORDER BY ts
                                 ROWS BETWEEN {GAP} PRECEDING AND CURRENT ROW) AS anomaly
        FROM raws),
    runs AS (
        SELECT job, min(ts) AS since, sum(anomaly) - {GAP} AS excess
        FROM (SELECT *, sum(changed) OVER (PARTITION BY job ORDER BY ts) AS run
              FROM (SELECT *, CASE WHEN anomaly = lag(anomaly) OVER (PARTITION BY job ORDER BY ts)
                                   THEN 0 ELSE 1 END AS changed FROM flagged))
        GROUP BY job, run HAVING sum(anomaly) - {GAP} > 0)"""


def _residuals(spark: SparkSession, sf: str) -> DataFrame:
    return fleet.residual_hours(t.job_hours(fleet.reduced_hours(spark, sf)))


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    rows = _residuals(spark, sf)
    flagged = anomaly.detect_anomalies(rows, anomaly.residual_moments(rows), gap=GAP)
    return session.materialise(flagged, "flagged")


@query(
    "residual_moments",
    with_tables(
        JOB_HOURS,
        f""", {FLAGGED} SELECT job, n, round(mean, 6) AS mean, round(std, 6) AS std FROM moments""",
    ),
)
def residual_moments(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(anomaly.residual_moments(_residuals(spark, sf)))


@query(
    "detect_anomalies",
    with_tables(
        JOB_HOURS,
        f", {FLAGGED} SELECT job, CAST(epoch(ts) AS BIGINT) AS ts, raw, anomaly FROM flagged",
    ),
)
def detect_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return stamped(_flagged(spark, sf), "job", "ts", "raw", "anomaly")


LOOP_OF_TS = f"CAST(floor(epoch(ts) / {SET.loop_seconds}) AS BIGINT)"


@query(
    "detect_anomalies_as_of",
    with_tables(
        JOB_HOURS,
        f""", {RESIDUALS},
            looped AS (SELECT *, {LOOP_OF_TS} AS loop FROM residuals),
            known AS (
                SELECT DISTINCT job, loop, round(avg(residual) OVER w, 6) AS mean,
                       round(stddev_pop(residual) OVER w, 6) AS std
                FROM looped WINDOW w AS (PARTITION BY job ORDER BY loop
                                         RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            scored AS (
                SELECT job, ts, coalesce(CAST(abs(residual - mean) > std AS INTEGER), 0) AS raw
                FROM looped JOIN known USING (job, loop))
            SELECT job, CAST(epoch(ts) AS BIGINT) AS ts, raw,
                   max(raw) OVER (PARTITION BY job ORDER BY ts
                                  ROWS BETWEEN {GAP} PRECEDING AND CURRENT ROW) AS anomaly
            FROM scored""",
    ),
)
def detect_anomalies_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Residuals scored by what was known before their loop."""
    loop = F.floor(F.unix_seconds("ts") / SET.loop_seconds).cast("bigint")
    rows = session.materialise(_residuals(spark, sf).withColumn("loop", loop), "residuals")
    known = _rounded(anomaly.moments_before(rows))
    flagged = anomaly.detect_anomalies(rows, known, gap=GAP, as_of=("loop",))
    return stamped(flagged, "job", "ts", "raw", "anomaly")


@query(
    "anomaly_runs",
    with_tables(
        JOB_HOURS,
        f""", {FLAGGED} SELECT job, CAST(epoch(since) AS BIGINT) AS since,
                               CAST(excess AS BIGINT) AS excess FROM runs""",
    ),
)
def anomaly_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = anomaly.anomaly_runs(_flagged(spark, sf), gap=GAP)
    return runs.select("job", F.unix_seconds("since").alias("since"), "excess")


@query(
    "observed_recovery_time",
    with_tables(
        JOB_HOURS,
        f""", {FLAGGED}
            SELECT job, recovered, coalesce(runs, 0) AS runs,
                   round(coalesce(recovery_time, 0), 6) AS recovery_time
            FROM (SELECT job, max_by(anomaly, ts) = 0 AS recovered FROM flagged GROUP BY 1)
            LEFT JOIN (SELECT job, count(*) AS runs, avg(excess) AS recovery_time FROM runs GROUP BY 1)
            USING (job)""",
    ),
)
def observed_recovery_time(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(anomaly.observed_recovery_time(_flagged(spark, sf), gap=GAP))


# --- load lines and capacity -----------------------------------------------------------

# The line is folded loop by loop from the update rule itself.
LINES = f"""{LOOP_FRAMES},
    loop_pods AS (
        SELECT job, loop, pod, avg(cpu) AS cpu_mean, count(x) AS k, avg(x) AS mx, avg(y) AS my,
               var_pop(x) * count(x) AS sxx, covar_pop(x, y) * count(x) AS sxy,
               sum(x) AS cpu_sum, sum(y) AS throughput_sum
        FROM (SELECT *, CASE WHEN cpu IS NOT NULL AND throughput IS NOT NULL THEN cpu END AS x,
                     CASE WHEN cpu IS NOT NULL AND throughput IS NOT NULL THEN throughput END AS y
              FROM loop_frames)
        GROUP BY 1, 2, 3),
    sessions AS (
        SELECT *, sum(fresh) OVER (PARTITION BY job, pod ORDER BY loop) AS session
        FROM (SELECT *, max(cpu_mean) OVER (PARTITION BY job, loop) AS max_cpu_mean,
                     CASE WHEN loop - lag(loop) OVER (PARTITION BY job, pod ORDER BY loop) = 1
                          THEN 0 ELSE 1 END AS fresh
              FROM loop_pods)),
    numbered AS (
        SELECT *, row_number() OVER (PARTITION BY job, pod, session ORDER BY loop) AS i
        FROM sessions),
    lines AS (
        SELECT job, pod, session, i, loop, k, k AS n, mx AS mean_x, my AS mean_y,
               (k - 1) / k * (sxx + k * mx * mx) / k AS v, (k - 1) / k * (sxy + k * mx * my) / k AS c
        FROM numbered WHERE i = 1
        UNION ALL
        SELECT m.job, m.pod, m.session, m.i, m.loop, m.k, l.n + m.k,
               mean_x + m.k * (m.mx - mean_x) / (l.n + m.k),
               mean_y + m.k * (m.my - mean_y) / (l.n + m.k),
               v + ((l.n + m.k - 1) / (l.n + m.k) * (m.sxx + m.k * pow(m.mx - mean_x, 2)) - m.k * v)
                   / (l.n + m.k),
               c + ((l.n + m.k - 1) / (l.n + m.k) * (m.sxy + m.k * (m.mx - mean_x) * (m.my - mean_y))
                   - m.k * c) / (l.n + m.k)
        FROM lines l JOIN numbered m
          ON m.job = l.job AND m.pod = l.pod AND m.session = l.session AND m.i = l.i + 1),
    slopes AS (
        SELECT *, c / nullif(v, 0) AS slope, mean_y - c / nullif(v, 0) * mean_x AS intercept FROM lines),
    pod_capacity AS (
        SELECT s.job, s.pod, s.loop, 1 - (max_cpu_mean - mx) AS skew, slope, intercept,
               CAST(trunc(slope * (1 - (max_cpu_mean - mx)) + intercept) AS BIGINT) AS capacity
        FROM slopes s JOIN numbered m USING (job, pod, session, loop)),
    job_capacity AS (
        SELECT job, loop, CAST(sum(capacity) AS BIGINT) AS capacity FROM pod_capacity GROUP BY 1, 2)"""
LINE_COLUMNS = (
    "job, pod, loop, n, round(mean_x, 10) AS mean_x, round(mean_y, 10) AS mean_y, "
    "round(slope, 4) AS slope, round(intercept, 4) AS intercept"
)


def _loop_pods(hours: DataFrame) -> DataFrame:
    frames = capacity.loop_frames(hours, t.uptime(t.job_hours(hours)))
    return session.materialise(capacity.loop_pods(frames), "loop-pods")


def _lines_out(lines: DataFrame) -> DataFrame:
    columns = ("job", "pod", "loop", "n", "mean_x", "mean_y", "slope", "intercept")
    return _rounded(lines.select(*columns), 10, slope=4, intercept=4)


@query("load_lines", with_tables(JOB_HOURS, f", {LINES} SELECT {LINE_COLUMNS} FROM slopes"))
def load_lines(spark: SparkSession, sf: str) -> DataFrame:
    pods = _loop_pods(fleet.reduced_hours(spark, sf))
    return _lines_out(regression.fold_lines(regression.with_sessions(pods)))


@query("online_load_lines", with_tables(JOB_HOURS, f", {LINES} SELECT {LINE_COLUMNS} FROM slopes"))
def online_load_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same lines from streaming state, fed with one row per pod and loop."""
    root = session.shared_dir(spark, "online-lines")
    pods = _loop_pods(fleet.reduced_hours(spark, sf))
    pods.select("job", "pod", "loop", "k", "mx", "my", "sxx", "sxy").write.parquet(f"{root}/in")
    lines = online.online_lines(streams.read_table_stream(spark, f"{root}/in"))
    jobs.run_to_end(
        sinks.start_table(
            lines, f"{root}/out", f"{root}/checkpoint", "append", {"availableNow": True}
        )
    )
    return _lines_out(sinks.read_rows(spark, f"{root}/out"))


ONLINE_MOMENTS = f"""{RESIDUALS}
    SELECT job, loop, CAST(max(n) AS BIGINT) AS n, round(max_by(mean, ts), 11) AS mean,
           round(max_by(std, ts), 6) AS std
    FROM (SELECT job, ts, CAST(floor(epoch(ts) / 43200) AS BIGINT) AS loop, count(*) OVER w AS n,
                 avg(residual) OVER w AS mean, stddev_pop(residual) OVER w AS std
          FROM residuals WINDOW w AS (PARTITION BY job ORDER BY ts))
    GROUP BY 1, 2"""


@query("online_residual_moments", with_tables(JOB_HOURS, ", " + ONLINE_MOMENTS))
def online_residual_moments(spark: SparkSession, sf: str) -> DataFrame:
    root = session.shared_dir(spark, "online-moments")
    loop = F.floor(F.unix_seconds("ts") / SET.loop_seconds).cast("bigint")
    reduced = _residuals(spark, sf).groupBy("job", loop.alias("loop")).agg(
        F.count("residual").alias("k"),
        F.avg("residual").alias("mr"),
        (F.var_pop("residual") * F.count("residual")).alias("srr"),
    )
    reduced.write.parquet(f"{root}/in")
    moments = online.online_residual_moments(streams.read_table_stream(spark, f"{root}/in"))
    jobs.run_to_end(
        sinks.start_table(
            moments, f"{root}/out", f"{root}/checkpoint", "append", {"availableNow": True}
        )
    )
    return _rounded(sinks.read_rows(spark, f"{root}/out"), mean=11)


@query(
    "least_squares_lines",
    with_tables(
        "pod_hours",
        """ SELECT job, pod, count(*) AS n, round(regr_slope(throughput, cpu), 4) AS slope,
                   round(regr_intercept(throughput, cpu), 4) AS intercept
            FROM pod_hours WHERE cpu IS NOT NULL GROUP BY 1, 2""",
    ),
)
def least_squares_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.pod_hours(t.events(spark, sf)).filter("cpu IS NOT NULL")
    return _rounded(regression.least_squares_lines(rows), 4)


@query(
    "regression_score",
    with_tables(
        "pod_hours",
        """, ols AS (SELECT job, pod, regr_slope(throughput, cpu) AS b, regr_intercept(throughput, cpu) AS a
                     FROM pod_hours WHERE cpu IS NOT NULL GROUP BY 1, 2)
           SELECT job, pod, round(1 - sum(pow(throughput - (b * cpu + a), 2))
                                  / nullif(var_pop(throughput) * count(*), 0), 6) AS r2
           FROM pod_hours JOIN ols USING (job, pod) WHERE cpu IS NOT NULL GROUP BY 1, 2""",
    ),
)
def regression_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = fleet.reduced_hours(spark, sf).filter("cpu IS NOT NULL")
    return _rounded(regression.regression_score(rows, regression.least_squares_lines(rows)))


@query(
    "pod_capacity",
    with_tables(
        JOB_HOURS,
        f""", {LINES} SELECT job, pod, loop, round(skew, 10) AS skew, round(slope, 4) AS slope,
                             round(intercept, 4) AS intercept, capacity FROM pod_capacity""",
    ),
)
def pod_capacity(spark: SparkSession, sf: str) -> DataFrame:
    pods = capacity.pod_capacity(_loop_pods(fleet.reduced_hours(spark, sf)))
    return _rounded(pods, 4, skew=10)


@query("job_capacity", with_tables(JOB_HOURS, f", {LINES} SELECT job, loop, capacity FROM job_capacity"))
def job_capacity(spark: SparkSession, sf: str) -> DataFrame:
    pods = capacity.pod_capacity(_loop_pods(fleet.reduced_hours(spark, sf)))
    return capacity.job_capacity(pods)


@query(
    "simple_capacity",
    with_tables(
        JOB_HOURS,
        f""", {LINES},
            simple AS (
                SELECT job, pod, session, i, loop, CAST(trunc(throughput_sum / cpu_sum) AS DOUBLE) AS x
                FROM numbered WHERE i = 1
                UNION ALL
                SELECT m.job, m.pod, m.session, m.i, m.loop, (trunc(throughput_sum / cpu_sum) + x) / 2
                FROM simple s JOIN numbered m
                  ON m.job = s.job AND m.pod = s.pod AND m.session = s.session AND m.i = s.i + 1)
            SELECT job, pod, loop, round(x, 6) AS simple_capacity FROM simple""",
    ),
)
def simple_capacity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(capacity.simple_capacity(_loop_pods(fleet.reduced_hours(spark, sf))))


OBSERVED = f"""{LINES},
    scaled AS (
        SELECT f.job, f.loop, f.parallelism, c.capacity
        FROM loop_facts f LEFT JOIN job_capacity c USING (job, loop)),
    known AS (
        SELECT *, row_number() OVER (PARTITION BY job, parallelism ORDER BY loop) AS i
        FROM scaled WHERE capacity IS NOT NULL),
    observed AS (
        SELECT job, parallelism, loop, i, capacity AS observed FROM known WHERE i = 1
        UNION ALL
        SELECT k.job, k.parallelism, k.loop, k.i,
               CASE WHEN o.observed = 0 THEN k.capacity
                    ELSE CAST(trunc((o.observed + k.capacity) / 2) AS BIGINT) END
        FROM observed o JOIN known k
          ON k.job = o.job AND k.parallelism = o.parallelism AND k.i = o.i + 1)"""
FACTS = "pod_hours job_hours loop_facts"


@query(
    "observed_capacity",
    with_tables(FACTS, f", {OBSERVED} SELECT job, parallelism, loop, observed FROM observed"),
)
def observed_capacity(spark: SparkSession, sf: str) -> DataFrame:
    rows = fleet.reduced_hours(spark, sf)
    return capacity.observed_capacity(fleet.job_capacities(rows, t.job_hours(rows)))


CAPACITIES = f"""{OBSERVED},
    base AS (
        SELECT s.job, s.loop, s.parallelism, b.capacity, b.parallelism AS over
        FROM scaled s ASOF LEFT JOIN (SELECT * FROM scaled WHERE capacity IS NOT NULL) b
          ON s.job = b.job AND s.loop >= b.loop),
    candidates AS (
        SELECT *, unnest(generate_series(0, {SET.max_scaleout})) AS scaleout FROM base),
    capacities AS (
        SELECT c.job, c.loop, c.parallelism, CAST(c.scaleout AS INTEGER) AS scaleout,
               coalesce(nullif(o.observed, 0),
                        CAST(trunc(c.scaleout * (c.capacity::DOUBLE / c.over)) AS BIGINT), 0) AS capacity
        FROM candidates c ASOF LEFT JOIN observed o
          ON c.job = o.job AND c.scaleout = o.parallelism AND c.loop >= o.loop)"""


@query(
    "capacity_rows",
    with_tables(FACTS, f", {CAPACITIES} SELECT job, loop, parallelism, scaleout, capacity FROM capacities"),
)
def capacity_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = fleet.reduced_hours(spark, sf)
    loops = fleet.job_capacities(rows, t.job_hours(rows))
    return capacity.capacity_rows(capacity.capacity_table(loops, SET.max_scaleout))


# --- forecasts -------------------------------------------------------------------------

TREND = f"""
    trend AS (
        SELECT job, loop, count(*) AS n, regr_slope(workload, x) AS slope,
               regr_intercept(workload, x) AS intercept, max(ts) + INTERVAL 1 HOUR AS start
        FROM (SELECT *, row_number() OVER (PARTITION BY job, loop ORDER BY ts) - 1 AS x FROM job_hours)
        GROUP BY 1, 2),
    trend_steps AS (
        SELECT job, loop, start, idx, slope * (n + idx) + intercept AS yhat
        FROM (SELECT *, unnest(generate_series(0, {SET.horizon_steps - 1})) AS idx FROM trend)),
    flat_steps AS (
        SELECT job, loop, start, idx, level AS yhat
        FROM (SELECT job, loop, avg(workload) AS level, max(ts) + INTERVAL 1 HOUR AS start,
                     unnest(generate_series(0, {SET.horizon_steps - 1})) AS idx
              FROM job_hours GROUP BY 1, 2))"""


def _wape_sql(steps: str) -> str:
    return f"""
        SELECT job, loop, overlap, CASE WHEN total <> 0 THEN error / total ELSE 'inf'::DOUBLE END AS wape
        FROM (SELECT h.job, h.loop, count(f.yhat) AS overlap, sum(abs(h.workload - f.yhat)) AS error,
                     coalesce(sum(h.workload) FILTER (WHERE f.yhat IS NOT NULL), 0) AS total
              FROM job_hours h JOIN (
                SELECT job, loop, lag(loop) OVER (PARTITION BY job ORDER BY loop) AS before
                FROM (SELECT DISTINCT job, loop FROM job_hours)) p USING (job, loop)
              LEFT JOIN {steps} f
                ON f.job = h.job AND f.loop = p.before AND f.start + to_hours(f.idx) = h.ts
              GROUP BY 1, 2)"""


def _finite(df: DataFrame) -> DataFrame:
    """Infinite accuracies as null, for comparison."""
    return _rounded(df.withColumn("wape", F.when(F.col("wape") < float("inf"), F.col("wape"))))


FINITE = "CASE WHEN isfinite(wape) THEN round(wape, 6) END AS wape"


@query(
    "forecast_trend",
    with_tables(
        JOB_HOURS,
        f""", {TREND} SELECT job, loop, CAST(idx AS INTEGER) AS idx,
                             CAST(epoch(start + to_hours(idx)) AS BIGINT) AS ts, round(yhat, 6) AS yhat
              FROM trend_steps""",
    ),
)
def forecast_trend(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.job_hours(t.pod_hours(t.events(spark, sf)))
    trend = forecast.forecast_trend(rows, SET.horizon_steps, SET.step)
    return stamped(forecast.forecast_rows(trend, SET.step), "job", "loop", "idx", "ts", "yhat")


@query(
    "trend_accuracy",
    with_tables(
        JOB_HOURS,
        f", {TREND} SELECT job, loop, overlap, {FINITE} FROM ({_wape_sql('trend_steps')})",
    ),
)
def trend_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.job_hours(fleet.reduced_hours(spark, sf))
    trend = forecast.forecast_trend(rows, SET.horizon_steps, SET.step)
    return _finite(forecast.wape(rows, trend, SET.step))


CHOSEN = f"""{TREND},
    accuracy AS ({_wape_sql('flat_steps')}),
    chosen_steps AS (
        SELECT s.job, s.loop, s.idx, a.wape, CASE WHEN a.wape < 0.25 THEN 'model' ELSE 'trend' END AS source,
               CASE WHEN a.wape < 0.25 THEN m.yhat ELSE s.yhat END AS yhat
        FROM trend_steps s JOIN flat_steps m USING (job, loop, idx) JOIN accuracy a USING (job, loop))"""


def _chosen(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.job_hours(fleet.reduced_hours(spark, sf))
    model = fleet.flat_forecast(rows, SET)
    trend = forecast.forecast_trend(rows, SET.horizon_steps, SET.step)
    accuracy = forecast.wape(rows, model, SET.step)
    return forecast.choose_forecast(model, trend, accuracy)


@query(
    "choose_forecast",
    with_tables(
        JOB_HOURS,
        f""", {CHOSEN} SELECT job, loop, source, CAST(idx AS INTEGER) AS idx, round(yhat, 6) AS yhat
              FROM chosen_steps""",
    ),
)
def choose_forecast(spark: SparkSession, sf: str) -> DataFrame:
    steps = _chosen(spark, sf).select("job", "loop", "source", F.posexplode("forecast").alias("idx", "yhat"))
    return _rounded(steps)


@query(
    "bad_forecast_streaks",
    with_tables(
        JOB_HOURS,
        f""", {CHOSEN}
            SELECT job, loop, CAST(bad_streak AS BIGINT) AS bad_streak, bad_streak >= 15 AS needs_retrain
            FROM (SELECT job, loop, sum(bad) OVER (PARTITION BY job, run ORDER BY loop) AS bad_streak
                  FROM (SELECT *, CAST(overlap > 0 AND wape >= 0.10 AS INTEGER) AS bad,
                               sum(CAST(overlap > 0 AND wape < 0.10 AS INTEGER))
                                 OVER (PARTITION BY job ORDER BY loop) AS run
                        FROM accuracy))""",
    ),
)
def bad_forecast_streaks(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.job_hours(fleet.reduced_hours(spark, sf))
    accuracy = forecast.wape(rows, fleet.flat_forecast(rows, SET), SET.step)
    return forecast.bad_streaks(accuracy).select("job", "loop", "bad_streak", "needs_retrain")


# --- recovery and scale-out ------------------------------------------------------------

SITUATIONS = f"""{CAPACITIES}, {CHOSEN.lstrip()},
    ages AS (
        SELECT job, loop,
               CASE WHEN changed_at IS NOT NULL THEN (loop - changed_at) * {SET.loop_seconds}
                    ELSE (loop - first_loop) * {SET.loop_seconds} + 300 END AS since_rescale
        FROM (SELECT job, loop, min(loop) OVER w AS first_loop,
                     max(CASE WHEN parallelism <> prev THEN loop END) OVER w AS changed_at
              FROM (SELECT *, lag(parallelism) OVER (PARTITION BY job ORDER BY loop) AS prev FROM loop_facts)
              WINDOW w AS (PARTITION BY job ORDER BY loop))),
    options AS (
        SELECT c.job, c.loop, c.parallelism, c.scaleout, c.capacity, n.capacity AS current_capacity,
               f.avg_workload, f.tail_workload, f.lag, since_rescale,
               CASE WHEN c.scaleout < c.parallelism THEN {SET.down_steps} ELSE {SET.up_steps} END AS restart
        FROM capacities c
        JOIN capacities n ON n.job = c.job AND n.loop = c.loop AND n.scaleout = c.parallelism
        JOIN loop_facts f ON f.job = c.job AND f.loop = c.loop
        JOIN ages a ON a.job = c.job AND a.loop = c.loop
        ),
    blind AS (SELECT job, loop, count(yhat) = 0 AS blind FROM chosen_steps GROUP BY 1, 2),
    walk AS (
        SELECT o.job, o.loop, o.scaleout, s.idx, s.yhat, o.restart,
               sum(CASE WHEN idx < restart THEN yhat ELSE 0 END)
                 OVER (PARTITION BY o.job, o.loop, o.scaleout) AS waiting,
               sum(CASE WHEN idx < restart THEN 0 ELSE greatest(capacity - yhat, 0) END)
                 OVER (PARTITION BY o.job, o.loop, o.scaleout ORDER BY idx) AS spare
        FROM options o JOIN chosen_steps s ON s.job = o.job AND s.loop = o.loop),
    recovery AS (
        SELECT o.*, blind, CASE WHEN capacity <> 0 AND current_capacity <> 0 AND NOT blind
                         THEN CAST(coalesce(p, 10800) + restart AS INTEGER) END AS recovery_time
        FROM options o JOIN (
            SELECT o.job, o.loop, o.scaleout,
                   min(idx) FILTER (WHERE idx >= w.restart AND spare > trunc(tail_workload + waiting + lag)) AS p
            FROM options o JOIN walk w USING (job, loop, scaleout) GROUP BY 1, 2, 3) USING (job, loop, scaleout)
        JOIN blind USING (job, loop))"""


def _level_situations(spark: SparkSession, sf: str) -> DataFrame:
    """Situations under the level model, which SQL can follow."""
    hours = fleet.reduced_hours(spark, sf)
    return fleet.situations(hours, SET, fleet.flat_forecast(t.job_hours(hours), SET))


@query(
    "predict_recovery",
    with_tables(
        FACTS,
        f", {SITUATIONS} SELECT job, loop, parallelism, scaleout, capacity, recovery_time FROM recovery",
    ),
)
def predict_recovery(spark: SparkSession, sf: str) -> DataFrame:
    found = _level_situations(spark, sf)
    return recovery.predict_recovery(found, SET.up_steps, SET.down_steps)


@query(
    "fleet_plan_level",
    with_tables(
        FACTS,
        f""", {SITUATIONS},
            peaks AS (
                SELECT job, loop, max(yhat) AS peak, max(yhat) FILTER (WHERE idx < {SET.loop_steps}) AS near_peak
                FROM chosen_steps GROUP BY 1, 2),
            tested AS (
                SELECT r.*, peak, near_peak,
                       capacity > avg_workload AND recovery_time <= {SET.target_steps}
                       AND capacity >= (SELECT max(yhat) FROM chosen_steps s WHERE s.job = r.job
                                        AND s.loop = r.loop AND s.idx < r.recovery_time)
                       AND (scaleout = parallelism
                            OR (NOT (scaleout < parallelism AND current_capacity < lag) AND capacity > peak))
                       AS ok
                FROM recovery r JOIN peaks USING (job, loop)),
            best AS (
                SELECT job, loop, any_value(parallelism) AS parallelism, any_value(since_rescale) AS since,
                       any_value(current_capacity) AS current, any_value(avg_workload) AS w,
                       any_value(near_peak) AS near_peak, any_value(blind) AS blind, min(scaleout) FILTER (WHERE ok) AS found
                FROM tested GROUP BY 1, 2)
            SELECT job, loop, parallelism,
                   CASE WHEN since < 180 THEN 'stabilising' WHEN current = 0 THEN 'capacity unknown'
                        WHEN blind THEN 'no forecast'
                        WHEN since < {SET.calm_seconds} AND current > w AND current > near_peak THEN 'calm period'
                        WHEN found IS NOT NULL THEN 'fits' ELSE 'maximum' END AS reason,
                   CASE WHEN since < 180 OR current = 0 OR blind
                             OR (since < {SET.calm_seconds} AND current > w AND current > near_peak)
                        THEN parallelism ELSE coalesce(found, {SET.max_scaleout}) END AS target
            FROM best""",
    ),
)
def fleet_plan_level(spark: SparkSession, sf: str) -> DataFrame:
    """The plan under the level model."""
    hours = fleet.reduced_hours(spark, sf)
    planned = fleet.plan(hours, SET, fleet.flat_forecast(t.job_hours(hours), SET))
    return planned.select("job", "loop", "parallelism", "reason", "target")


@query("fleet_plan")
def fleet_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The plan under ARIMA forecasts, scored loop by loop against the trend, with downtimes
    that follow the observed recoveries."""
    planned = fleet.plan(fleet.reduced_hours(spark, sf), SET, feedback_gap=GAP)
    return planned.select("job", "loop", "parallelism", "source", "reason", "target")


@query("arima_loop_forecasts")
def arima_loop_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """ARIMA forecast of every loop, from what was known at its end."""
    made = fleet.arima_forecast(t.job_hours(fleet.reduced_hours(spark, sf)), SET)
    return _rounded(made.select("job", "loop", F.posexplode("forecast").alias("idx", "yhat")))


@query("arima_versions")
def arima_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of every job's ARIMA models, and the loops they were fitted at."""
    return fleet.arima_states(t.job_hours(fleet.reduced_hours(spark, sf)), SET)[1]


_TRIANGLE = ", ".join(f"({n}, {i}, {j})" for n, (i, j) in enumerate(zip(*loop_arima.UPPER)))


@query(
    "arima_loop_products",
    with_tables(
        JOB_HOURS,
        f""", y AS (SELECT job, loop, ts, workload - first(workload) OVER w AS y, row_number() OVER w AS pos
                    FROM job_hours WINDOW w AS (PARTITION BY job ORDER BY ts)),
            lagged AS (SELECT job, loop, pos, [1.0, y, {", ".join(f"lag(y, {k}) OVER w" for k in range(1, loop_arima.LAGS + 1))}] AS z
                       FROM y WINDOW w AS (PARTITION BY job ORDER BY ts)),
            triangle(place, i, j) AS (VALUES {_TRIANGLE}),
            added AS (SELECT job, loop, place,
                             sum(CASE WHEN pos > {loop_arima.LAGS} THEN z[i + 1] * z[j + 1] ELSE 0 END) AS v
                      FROM lagged, triangle GROUP BY ALL)
            SELECT job, loop, CAST(place AS INTEGER) AS place,
                   round(sum(v) OVER (PARTITION BY job, place ORDER BY loop), 3) AS value
            FROM added""",
    ),
)
def arima_loop_products(spark: SparkSession, sf: str) -> DataFrame:
    """The summed products that each loop's coefficients are solved from."""
    states = loop_arima.loop_states(t.job_hours(fleet.reduced_hours(spark, sf)))
    return _rounded(states.select("job", "loop", F.posexplode("products").alias("place", "value")), 3)


@query(
    "level_refits",
    with_tables(
        JOB_HOURS,
        f""", ends AS (SELECT job, loop, max(ts) AS until FROM job_hours GROUP BY ALL),
            linked AS (SELECT job, loop, lag(loop) OVER w AS made, lag(until) OVER w AS until
                       FROM ends WINDOW w AS (PARTITION BY job ORDER BY loop)),
            pairs AS (SELECT job, loop, made, workload FROM job_hours JOIN linked USING (job, loop)
                      WHERE date_diff('hour', until, ts) BETWEEN 1 AND {SET.horizon_steps}),
            versions AS (
                SELECT job, since, since AS cutoff, round(avg(workload), 6) AS level
                FROM (SELECT job, min(loop) AS since
                      FROM (SELECT job, loop, min(loop) OVER (PARTITION BY job) AS begin FROM ends)
                      WHERE loop >= begin + {loop_arima.FIRST_FIT} GROUP BY job)
                JOIN job_hours USING (job) WHERE loop <= since GROUP BY ALL
                UNION ALL (
                WITH judged AS (
                    SELECT v.job, p.loop,
                           NOT coalesce(sum(abs(workload - level)) / nullif(sum(workload), 0) < {forecast.GOOD_WAPE}, false) AS bad
                    FROM versions v JOIN pairs p ON p.job = v.job AND p.made >= v.since GROUP BY ALL),
                parts AS (
                    SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY job ORDER BY loop) AS part
                    FROM judged),
                streaks AS (
                    SELECT job, loop, sum(bad::INTEGER) OVER (PARTITION BY job, part ORDER BY loop) AS streak
                    FROM parts),
                events AS (
                    SELECT job, min(loop) AS cutoff FROM streaks WHERE streak >= {forecast.RETRAIN_AFTER} GROUP BY job)
                SELECT job, cutoff + 1, cutoff, round(avg(workload), 6)
                FROM events JOIN job_hours USING (job) WHERE loop <= cutoff GROUP BY job, cutoff))
            SELECT * FROM versions""",
    ),
)
def level_refits(spark: SparkSession, sf: str) -> DataFrame:
    """When a model that SQL can follow, the mean of all rows so far, is fitted again."""
    rows = session.materialise(
        t.job_hours(fleet.reduced_hours(spark, sf)).select("job", "loop", "ts", "workload"), "workload"
    )

    def fit(events: DataFrame) -> DataFrame:
        known = rows.join(events, "job").where("loop <= cutoff")
        return known.groupBy("job", "since", "cutoff").agg(F.round(F.avg("workload"), 6).alias("level"))

    def score(versions: DataFrame) -> DataFrame:
        later = rows.join(versions, "job").where("loop >= since")
        made = later.groupBy("job", "loop").agg(
            (F.max("ts") + F.make_dt_interval(secs=F.lit(SET.step))).alias("start"),
            F.array_repeat(F.first("level"), SET.horizon_steps).alias("forecast"),
        )
        return forecast.wape(later.select("job", "loop", "ts", "workload"), made, SET.step)

    return loop_arima.versions_by_events(loop_arima.first_events(rows), fit, score)


# A model given in full, so that SQL can follow the recursion: once differenced, two lags, one
# past shock, shocks taken from a first-order autoregression.
GIVEN = {"d": 1, "const": 0.5, "ar": [0.6, -0.2], "ma": [0.3], "long": [0.1, 0.4]}
STEPS_BACK = "PARTITION BY job ORDER BY ts"


@query(
    "arima_recursion",
    with_tables(
        JOB_HOURS,
        f""", level AS (SELECT job, avg(workload) AS level FROM job_hours GROUP BY 1),
            w AS (SELECT job, ts, workload - level AS y, workload - lag(workload) OVER ({STEPS_BACK}) AS w
                  FROM job_hours JOIN level USING (job)),
            back AS (SELECT job, ts, y, w, lag(w) OVER ({STEPS_BACK}) AS w1
                     FROM w),
            newest AS (SELECT *, w - {GIVEN["long"][0]} - {GIVEN["long"][1]} * w1 AS shock
                       FROM back WHERE (job, ts) IN (SELECT (job, max(ts)) FROM job_hours GROUP BY job)),
            steps AS (
                SELECT job, 0 AS idx, w AS last,
                       {GIVEN["const"]} + {GIVEN["ar"][0]} * w + {GIVEN["ar"][1]} * w1
                         + {GIVEN["ma"][0]} * shock AS next, y AS sum
                FROM newest
                UNION ALL
                SELECT job, idx + 1, next, {GIVEN["const"]} + {GIVEN["ar"][0]} * next + {GIVEN["ar"][1]} * last,
                       sum + next
                FROM steps WHERE idx < {SET.horizon_steps})
            SELECT job, CAST(idx - 1 AS INTEGER) AS idx, round(sum + level, 6) AS yhat
            FROM steps JOIN level USING (job) WHERE idx > 0""",
    ),
)
def arima_recursion(spark: SparkSession, sf: str) -> DataFrame:
    """Continue every job's workload by a given model."""
    rows = t.job_hours(fleet.reduced_hours(spark, sf)).select("job", "ts", "workload")
    long_ar = [*GIVEN["long"], *[0.0] * (arima.LONG_AR - 1)]
    models = rows.select("job").distinct().select(
        "job",
        F.lit(GIVEN["d"]).alias("d"),
        F.lit(GIVEN["const"]).alias("const"),
        *(F.array(*map(F.lit, GIVEN[c])).alias(c) for c in ("ar", "ma")),
        F.array(*map(F.lit, long_ar)).alias("long_ar"),
    )
    made = arima.forecast_arima(rows, models, SET.horizon_steps, step=SET.step)
    return _rounded(made.select("job", F.posexplode("forecast").alias("idx", "yhat")))


SIDE = arima.LONG_AR + 2


@query(
    "arima_lagged_products",
    with_tables(
        JOB_HOURS,
        f""", w AS (SELECT job, ts, workload - lag(workload) OVER ({STEPS_BACK}) AS w FROM job_hours),
            lags AS (SELECT job, [1.0, {", ".join(f"lag(w, {k}) OVER ({STEPS_BACK})" for k in range(1, arima.LONG_AR + 1))}, w] AS a
                     FROM w)
            SELECT job, CAST(i * {SIDE} + j AS INTEGER) AS i, round(sum(a[i + 1] * a[j + 1]), 4) AS value
            FROM lags, range({SIDE}) AS r(i), range({SIDE}) AS s(j)
            WHERE a[{SIDE - 1}] IS NOT NULL GROUP BY ALL""",
    ),
)
def arima_lagged_products(spark: SparkSession, sf: str) -> DataFrame:
    """The summed products that the long autoregression is solved from, once differenced."""
    rows = t.job_hours(fleet.reduced_hours(spark, sf)).select("job", "ts", "workload")
    summed = arima.lagged_products(rows, 1)
    return _rounded(summed.select("job", "i", "value"), 4)


@query(
    "adjust_downtime",
    with_tables(
        FACTS,
        f""", {SITUATIONS}, {RESIDUALS.lstrip()},
            looped AS (SELECT *, {LOOP_OF_TS} AS loop FROM residuals),
            moments_known AS (
                SELECT DISTINCT job, loop, round(avg(residual) OVER w, 6) AS mean,
                       round(stddev_pop(residual) OVER w, 6) AS std
                FROM looped WINDOW w AS (PARTITION BY job ORDER BY loop
                                         RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            epochs AS (
                SELECT *, sum(CASE WHEN parallelism <> prev THEN 1 ELSE 0 END)
                            OVER (PARTITION BY job ORDER BY loop) AS epoch
                FROM (SELECT job, loop, parallelism, lag(parallelism) OVER w AS prev, lag(loop) OVER w AS before
                      FROM loop_facts WINDOW w AS (PARTITION BY job ORDER BY loop))),
            epoch_flags AS (
                SELECT job, epoch, ts, max(raw) OVER (PARTITION BY job, epoch ORDER BY ts
                                                      ROWS BETWEEN {GAP} PRECEDING AND CURRENT ROW) AS anomaly
                FROM (SELECT job, epoch, ts, coalesce(CAST(abs(residual - mean) > std AS INTEGER), 0) AS raw
                      FROM looped JOIN moments_known USING (job, loop) JOIN epochs USING (job, loop))),
            epoch_runs AS (
                SELECT job, epoch, sum(anomaly) - {GAP} AS excess
                FROM (SELECT *, sum(changed) OVER (PARTITION BY job, epoch ORDER BY ts) AS run
                      FROM (SELECT *, CASE WHEN anomaly = lag(anomaly) OVER (PARTITION BY job, epoch ORDER BY ts)
                                           THEN 0 ELSE 1 END AS changed FROM epoch_flags))
                GROUP BY job, epoch, run HAVING sum(anomaly) - {GAP} > 0),
            seen AS (
                SELECT job, epoch, coalesce(avg(excess), 0) AS observed
                FROM (SELECT DISTINCT job, epoch FROM epochs) LEFT JOIN epoch_runs USING (job, epoch)
                GROUP BY 1, 2),
            feed AS (
                SELECT e.job, e.loop, CASE WHEN e.parallelism > prev THEN 'up' ELSE 'down' END AS direction,
                       observed, r.recovery_time AS predicted
                FROM epochs e JOIN seen s ON s.job = e.job AND s.epoch = e.epoch
                JOIN recovery r ON r.job = e.job AND r.loop = e.before AND r.scaleout = e.parallelism
                WHERE e.parallelism <> prev AND r.recovery_time IS NOT NULL)
            SELECT job, loop, direction,
                   CAST(CASE direction WHEN 'up' THEN {SET.up_steps} ELSE {SET.down_steps} END
                        + sum(CASE WHEN observed > predicted THEN 1 ELSE -1 END)
                          OVER (PARTITION BY job, direction ORDER BY loop) AS BIGINT) AS downtime
            FROM feed""",
    ),
)
def adjust_downtime(spark: SparkSession, sf: str) -> DataFrame:
    """Downtimes after each rescale, from predicted and observed recovery."""
    found = session.materialise(_level_situations(spark, sf), "situations")
    loop = F.floor(F.unix_seconds("ts") / SET.loop_seconds).cast("bigint")
    taught = fleet.rescale_feedback(fleet.reduced_hours(spark, sf), found, SET, loop, GAP)
    return taught.select("job", "loop", "direction", F.col("downtime").cast("bigint").alias("downtime"))


@query("arima_forecast")
def arima_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Fit every job's hourly workload and continue it by the horizon."""
    rows = session.materialise(
        t.job_hours(fleet.reduced_hours(spark, sf)).select("job", "ts", "workload"), "workload"
    )
    slices = F.floor(F.unix_seconds("ts") / (7 * 86400))
    models = session.materialise(arima.fit_arima(rows, slice_by=slices), "arima")
    made = arima.forecast_arima(rows, models, SET.horizon_steps, step=SET.step, slice_by=slices)
    return made.select("job", "start", F.posexplode("forecast").alias("idx", "yhat"))
