"""Event streams and job telemetry derived from the relational test tables.

Every adapter has an SQL twin in `SQL`, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadlens import session

HOUR = 3600
LOOP_HOURS = 12
JOBS, PODS = 5, 6
MAX_SCALEOUT = 8
# A cell whose summed value stays below this reports no cpu.
CPU_FLOOR = 10.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with an instant for `ts`; watermarks reject zone-less timestamps."""
    return with_instants(table(spark, sf_dir, "events"))


def with_instants(raw: DataFrame) -> DataFrame:
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def ad_events(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id", "ts", F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("et")
    )


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ads are suppliers, campaigns their nations; a third of the event users is no supplier."""
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("ad_id"),
        F.concat(F.lit("campaign-"), F.col("s_nationkey").cast("string")).alias("campaign_id"),
    )


def lattice() -> tuple[Column, Column]:
    k = F.from_json("props", "k int")["k"]
    m = F.round(F.col("value") * 100).cast("bigint") % 10000
    return k, m


def points(rows: DataFrame) -> DataFrame:
    """Vehicle positions on a lattice around the observed area, as 32-bit floats."""
    k, m = lattice()
    return rows.select(
        "event_id",
        F.col("user_id").cast("string").alias("lp"),
        (F.lit(52.50) + k * 0.0003).cast("float").alias("lat"),
        (F.lit(13.37) + m * 0.000003).cast("float").alias("lon"),
        "ts",
        "value",
        "event_type",
    )


def lattice_nodes(rows: DataFrame) -> DataFrame:
    k, m = lattice()
    return rows.select(
        F.concat_ws("-", k, m).alias("id"),
        (F.lit(52.50) + k * 0.0003).alias("latitude"),
        (F.lit(13.37) + m * 0.000003).alias("longitude"),
    ).distinct()


def pod_hours(rows: DataFrame) -> DataFrame:
    """Hourly telemetry of a fleet: `(job, pod, ts, loop, workload, throughput, cpu, lag)`."""
    job = F.concat(F.lit("job-"), (F.col("user_id") % JOBS).cast("string"))
    pod = F.concat(F.lit("pod-"), (F.floor(F.col("user_id") / JOBS) % PODS).cast("string"))
    failed = F.col("event_type") == "error"
    load = F.sum("value")
    hours = rows.groupBy(
        job.alias("job"), pod.alias("pod"), F.date_trunc("hour", "ts").alias("ts")
    ).agg(
        (F.sum(F.round("value")) / 4).alias("workload"),
        F.count(F.when(~failed, 1)).cast("double").alias("throughput"),
        F.when(load >= CPU_FLOOR, F.least(F.lit(1.0), load / 997)).alias("cpu"),
        F.count(F.when(failed, 1)).cast("double").alias("lag"),
    )
    return hours.withColumn(
        "loop", F.floor(F.unix_seconds("ts") / (LOOP_HOURS * HOUR)).cast("bigint")
    )


def samples(hours: DataFrame) -> DataFrame:
    """The same telemetry as long samples."""
    return hours.unpivot(
        ["job", "pod", "ts"], ["throughput", "cpu", "lag"], "metric", "value"
    ).filter(F.col("value").isNotNull())


def job_hours(hours: DataFrame) -> DataFrame:
    """Per job and hour: workload, throughput, lag and pods alive."""
    return hours.groupBy("job", "loop", "ts").agg(
        F.sum("workload").alias("workload"),
        F.sum("throughput").alias("throughput"),
        F.sum("lag").alias("lag"),
        F.count(F.lit(1)).cast("int").alias("alive"),
    )


def uptime(job_rows: DataFrame) -> DataFrame:
    """Milliseconds since a job's first hour."""
    first = job_rows.groupBy("job").agg(F.min("ts").alias("first"))
    return job_rows.join(first, "job").select(
        "job", "ts", (F.unix_millis("ts") - F.unix_millis("first")).alias("uptime")
    )


def loop_facts(job_rows: DataFrame) -> DataFrame:
    """Per job and loop: workload figures, tail of the workload, last lag and parallelism."""
    in_loop = Window.partitionBy("job", "loop").orderBy(F.col("ts").desc())
    ranked = job_rows.repartition("job", "loop").withColumn("r", F.row_number().over(in_loop))
    return ranked.groupBy("job", "loop").agg(
        F.max("workload").cast("bigint").alias("max_workload"),
        F.avg("workload").cast("bigint").alias("avg_workload"),
        F.min("workload").cast("bigint").alias("min_workload"),
        F.sum(F.when(F.col("r") <= 10, F.col("workload"))).alias("tail_workload"),
        F.max_by("lag", "ts").alias("lag"),
        F.max_by("alive", "ts").alias("parallelism"),
    )


SQL = {
    "ad_events": """
        ad_events AS (
            SELECT event_id, ts, CAST(user_id AS VARCHAR) AS id, event_type AS et FROM events
        )""",
    "campaigns": """
        campaigns AS (
            SELECT CAST(s_suppkey AS VARCHAR) AS ad_id,
                   'campaign-' || CAST(s_nationkey AS VARCHAR) AS campaign_id
            FROM supplier
        )""",
    "lattice": """
        lattice AS (
            SELECT event_id, user_id, ts, value, event_type,
                   CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
                   CAST(round(value * 100) AS BIGINT) % 10000 AS m
            FROM events
        )""",
    "points": """
        points AS (
            SELECT event_id, CAST(user_id AS VARCHAR) AS lp,
                   CAST(CAST(52.50 AS DOUBLE) + k * CAST(0.0003 AS DOUBLE) AS FLOAT) AS lat,
                   CAST(CAST(13.37 AS DOUBLE) + m * CAST(0.000003 AS DOUBLE) AS FLOAT) AS lon,
                   ts, value, event_type
            FROM lattice
        )""",
    "pod_hours": """
        pod_hours AS (
            SELECT 'job-' || CAST(user_id % 5 AS VARCHAR) AS job,
                   'pod-' || CAST((user_id // 5) % 6 AS VARCHAR) AS pod,
                   date_trunc('hour', ts) AS ts,
                   CAST(floor(epoch(date_trunc('hour', ts)) / 43200) AS BIGINT) AS loop,
                   sum(round(value)) / 4 AS workload,
                   CAST(count(*) FILTER (WHERE event_type <> 'error') AS DOUBLE) AS throughput,
                   CASE WHEN sum(value) >= 10 THEN least(1.0::DOUBLE, sum(value) / 997) END AS cpu,
                   CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS lag
            FROM events GROUP BY 1, 2, 3, 4
        )""",
    "samples": """
        samples AS (
            SELECT job, pod, ts, 'throughput' AS metric, throughput AS value FROM pod_hours
            UNION ALL SELECT job, pod, ts, 'cpu', cpu FROM pod_hours WHERE cpu IS NOT NULL
            UNION ALL SELECT job, pod, ts, 'lag', lag FROM pod_hours
        )""",
    "job_hours": """
        job_hours AS (
            SELECT job, loop, ts, sum(workload) AS workload, sum(throughput) AS throughput,
                   sum(lag) AS lag, CAST(count(*) AS INTEGER) AS alive
            FROM pod_hours GROUP BY 1, 2, 3
        )""",
    "loop_facts": """
        loop_facts AS (
            SELECT job, loop,
                   CAST(trunc(max(workload)) AS BIGINT) AS max_workload,
                   CAST(trunc(avg(workload)) AS BIGINT) AS avg_workload,
                   CAST(trunc(min(workload)) AS BIGINT) AS min_workload,
                   sum(workload) FILTER (WHERE r <= 10) AS tail_workload,
                   max_by(lag, ts) AS lag, max_by(alive, ts) AS parallelism
            FROM (SELECT *, row_number() OVER (PARTITION BY job, loop ORDER BY ts DESC) AS r
                  FROM job_hours)
            GROUP BY 1, 2
        )""",
}


def with_tables(names: str, body: str) -> str:
    """`WITH` the named adapters (blank separated, in dependency order) before a query."""
    return "WITH RECURSIVE " + ",".join(SQL[n] for n in names.split()) + body


def sql_distance(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Geodesic length as SQL text, by the iterated textbook solution (T. Vincenty, 1975).

    `functions.geo` takes another, closed formula for legs as short as those of the tables.
    """

    def let(name: str, value: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    f, a = "(1/298.257223563::DOUBLE)", "6378137.0::DOUBLE"
    b = f"({a} * (1 - {f}))"
    arc = "sqrt(pow(u.c2*sin(l),2) + pow(u.c1*u.s2 - u.s1*u.c2*cos(l),2))"
    terms = (
        f"{{'u': u, 'ss': {arc}, 'cs': u.s1*u.s2 + u.c1*u.c2*cos(l),"
        f" 'sa': coalesce(u.c1*u.c2*sin(l) / nullif({arc}, 0), 0)}}"
    )
    more = (
        "{'ss': t.ss, 'cs': t.cs, 'sa': t.sa, 'sig': atan2(t.ss, t.cs), 'c2a': 1 - t.sa*t.sa,"
        " 'cm': t.cs - 2*t.u.s1*t.u.s2 / (1 - t.sa*t.sa), 'span': t.u.span}"
    )
    c = f"({f}/16 * g.c2a * (4 + {f}*(4 - 3*g.c2a)))"
    moved = (
        f"g.span + (1 - {c}) * {f} * g.sa *"
        f" (g.sig + {c}*g.ss*(g.cm + {c}*g.cs*(2*g.cm*g.cm - 1)))"
    )
    lam = "list_reduce([u.span, 0, 0, 0, 0, 0, 0, 0], lambda l, z: " + let(
        "t", terms, let("g", more, moved)
    ) + ")"
    uu = f"(g.c2a * ({a}*{a} - {b}*{b}) / ({b}*{b}))"
    big_a = f"(1 + {uu}/16384*(4096 + {uu}*(-768 + {uu}*(320 - 175*{uu}))))"
    big_b = f"({uu}/1024*(256 + {uu}*(-128 + {uu}*(74 - 47*{uu}))))"
    change = (
        f"{big_b}*g.ss*(g.cm + {big_b}/4*(g.cs*(2*g.cm*g.cm - 1)"
        f" - {big_b}/6*g.cm*(4*g.ss*g.ss - 3)*(4*g.cm*g.cm - 3)))"
    )
    metres = let("l", lam, let("t", terms, let("g", more, f"{b}*{big_a}*(g.sig - {change})")))
    u1, u2 = (f"atan((1 - {f})*tan(radians({lat})))" for lat in (lat1, lat2))
    start = (
        f"{{'s1': sin({u1}), 'c1': cos({u1}), 's2': sin({u2}), 'c2': cos({u2}),"
        f" 'span': radians({lon2} - {lon1})}}"
    )
    return let("u", start, metres)
