"""Queries on event streams: decoding, campaigns, words, vehicles, streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens import session
from loadlens.operators import ads, series, telemetry, traffic, words
from loadlens.operators.scan import epoch, running, time_slice
from loadlens.plans import tables as t
from loadlens.plans.registry import ORACLES, query
from loadlens.plans.tables import sql_distance, with_tables
from loadlens.sources import codecs, files, replay, streams
from loadlens.streaming import epoch_log, jobs, progress, sinks, upserts

UPDATE_MS = 1000


# --- decoding --------------------------------------------------------------------------


def _ad_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Ad events on the wire; errors carry an unreadable time."""
    rows = t.events(spark, sf)
    line = codecs.encode_ad_event(F.col("ts"), F.col("user_id"), F.col("event_type"))
    broken = F.regexp_replace(line, '"ts":"[0-9]+"', '"ts":"n/a"')
    return rows.select(F.when(F.col("event_type") == "error", broken).otherwise(line).alias("value"))


@query(
    "decode_ad_events",
    """SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CAST(user_id AS VARCHAR) AS id,
              event_type AS et
       FROM events WHERE event_type <> 'error'""",
)
def decode_ad_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = codecs.decode_ad_events(_ad_lines(spark, sf))
    return rows.select(F.unix_seconds("ts").alias("ts_s"), "id", "et")


@query(
    "rejected_ad_events",
    """SELECT '{"ts":"n/a","id":"' || CAST(user_id AS VARCHAR) || '","et":"error"}' AS value
       FROM events WHERE event_type = 'error'""",
)
def rejected_ad_events(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.rejected_ad_events(_ad_lines(spark, sf))


def _traffic_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Traffic events on the wire; clicks have one token too many, sign-ups a textual latitude."""
    rows = t.points(t.events(spark, sf))
    line = codecs.encode_traffic_event(F.col("lp"), F.col("lat"), F.col("lon"), F.col("ts"))
    value = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("x,"), line))
        .when(F.col("event_type") == "signup", F.regexp_replace(line, '"lt":', '"lt":"n" '))
        .otherwise(line)
    )
    return rows.select(value.alias("value"))


@query(
    "decode_traffic_events",
    with_tables(
        "lattice points",
        """ SELECT lp, round(CAST(lat AS DOUBLE), 5) AS lat, round(CAST(lon AS DOUBLE), 5) AS lon,
                   CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms
            FROM points WHERE event_type NOT IN ('click', 'signup')""",
    ),
)
def decode_traffic_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = codecs.decode_traffic_events(_traffic_lines(spark, sf))
    return rows.select(
        "lp",
        F.round(F.col("lat").cast("double"), 5).alias("lat"),
        F.round(F.col("lon").cast("double"), 5).alias("lon"),
        F.unix_millis("ts").alias("ts_ms"),
    )


@query(
    "traffic_line_status",
    """SELECT CASE event_type WHEN 'click' THEN 'invalid' WHEN 'signup' THEN 'unmapped' ELSE 'ok' END
              AS status, count(*) AS lines
       FROM events GROUP BY 1""",
)
def traffic_line_status(spark: SparkSession, sf: str) -> DataFrame:
    parsed = codecs.parse_traffic_events(_traffic_lines(spark, sf))
    return parsed.groupBy("status").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "parse_workload_curve",
    """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS timestamp,
              CAST(count(*) AS INTEGER) AS value
       FROM events GROUP BY 1""",
)
def parse_workload_curve(spark: SparkSession, sf: str) -> DataFrame:
    hourly = t.events(spark, sf).groupBy(F.date_trunc("hour", "ts").alias("h")).count()
    lines = hourly.select(F.format_string("%d|%d", F.unix_seconds("h"), "count").alias("value"))
    return codecs.parse_curve_lines(lines)


@query("workload_curve_file", ORACLES["parse_workload_curve"])
def workload_curve_file(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly curve written as a delimited file and read back."""
    hourly = t.events(spark, sf).groupBy(F.unix_seconds(F.date_trunc("hour", "ts")).alias("second")).count()
    path = session.shared_dir(spark, "curve")
    files.write_curve(hourly, path)
    return files.read_workload_curve(spark, path)


@query(
    "campaign_of_position",
    """SELECT a.c_name AS ad_id, c.c_name AS campaign_id
       FROM customer a JOIN customer c ON a.c_custkey // 10 = c.c_custkey""",
)
def campaign_of_position(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "customer")
    listed = rows.select(F.col("c_custkey").alias("i"), F.col("c_name").alias("ad_id"))
    return files.campaign_of_position(listed, listed.withColumnRenamed("ad_id", "campaign_id"), 10)


# --- campaigns -------------------------------------------------------------------------

VIEWS = "SELECT id, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM ad_events WHERE et = 'view'"
COUNTS = """
    SELECT coalesce(campaign_id, 'UNKNOWN') AS campaign_id, count(*) AS ct,
           CAST(epoch(date_trunc('hour', ts)) AS BIGINT) * 1000 + 3600000 AS window_end_ms
    FROM ad_events LEFT JOIN campaigns ON id = ad_id
    WHERE et = 'view' GROUP BY 1, 3"""


def _counts_out(df: DataFrame) -> DataFrame:
    return df.select("campaign_id", "ct", F.unix_millis("window_end").alias("window_end_ms"))


@query("view_events", with_tables("ad_events", " " + VIEWS))
def view_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = ads.views(t.ad_events(t.events(spark, sf)))
    return rows.select("id", F.unix_micros("ts").alias("ts_us"))


@query(
    "enrich_with_campaign",
    with_tables(
        "ad_events campaigns",
        f""" SELECT v.id, v.ts_us, coalesce(campaign_id, 'UNKNOWN') AS campaign_id
             FROM ({VIEWS}) v LEFT JOIN campaigns ON v.id = ad_id""",
    ),
)
def enrich_with_campaign(spark: SparkSession, sf: str) -> DataFrame:
    return ads.enrich_with_campaign(view_events(spark, sf), t.campaigns(spark, sf))


@query("campaign_window_counts", with_tables("ad_events campaigns", COUNTS))
def campaign_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.ad_events(t.events(spark, sf))
    return _counts_out(ads.campaign_window_counts(rows, t.campaigns(spark, sf), "1 hour"))


@query(
    "encode_campaign_counts",
    with_tables(
        "ad_events campaigns",
        f""" SELECT '{{"id":"' || campaign_id || '","ct":' || CAST(ct AS VARCHAR) || ',"ts":'
                    || CAST(window_end_ms AS VARCHAR) || '}}' AS value FROM ({COUNTS})""",
    ),
)
def encode_campaign_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.ad_events(t.events(spark, sf))
    return codecs.encode_campaign_counts(
        ads.campaign_window_counts(rows, t.campaigns(spark, sf), "1 hour")
    )


# --- words -----------------------------------------------------------------------------

WORDS = r"""
    SELECT word, count(*) AS count
    FROM (SELECT unnest(string_split_regex(lower(text), '\W+')) AS word FROM documents)
    WHERE word <> '' GROUP BY 1"""
# Trailing empty tokens are cut off before the split; an empty line is one empty token.
SPACES = r"""
    SELECT word, count(*) AS count
    FROM (SELECT unnest(CASE WHEN text = '' THEN [''] WHEN rtrim(text, ' ') = '' THEN []
                             ELSE string_split(rtrim(text, ' '), ' ') END) AS word
          FROM documents)
    GROUP BY 1"""
CHANGELOG = r"""
    SELECT word, count(*) AS count
    FROM (SELECT unnest(CASE WHEN l = '' THEN [''] WHEN regexp_replace(l, '\W+\z', '') = '' THEN []
                             ELSE string_split_regex(regexp_replace(l, '\W+\z', ''), '\W+') END)
                 AS word
          FROM (SELECT lower(text) AS l FROM documents))
    GROUP BY 1"""


def _word_count(dialect: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return words.word_count(t.table(spark, sf, "documents"), "text", dialect)

    return run


query("word_count_words", WORDS)(_word_count("words"))
query("word_count_spaces", SPACES)(_word_count("spaces"))
query("word_count_changelog", CHANGELOG)(_word_count("changelog"))


@query(
    "encode_word_count",
    f"""SELECT '("' || word || '", ' || CAST(count AS VARCHAR) || ')' AS value FROM ({WORDS})""",
)
def encode_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.encode_word_count(_word_count("words")(spark, sf))


# --- vehicles --------------------------------------------------------------------------

# Centre as 32-bit floats, like the stored points.
CENTRE = "CAST(CAST(52.51623 AS FLOAT) AS DOUBLE)", "CAST(CAST(13.38532 AS FLOAT) AS DOUBLE)"
LAT, LON = "CAST(lat AS DOUBLE)", "CAST(lon AS DOUBLE)"
SPEEDS = f"""
    SELECT CAST(window_end_ms AS BIGINT) AS window_end_ms, lp,
           max_by(lat, (ts, lat, lon)) AS lat, max_by(lon, (ts, lat, lon)) AS lon,
           CAST(CASE WHEN count(hop) = 0 THEN 0
                ELSE trunc((sum(hop) / 1000) / (count(hop) * 1000 / 3600000.0::DOUBLE)) END
                AS INTEGER) AS avg_speed
    FROM (
        SELECT *, {sql_distance(LAT.replace("lat", "plat"), LON.replace("lon", "plon"), LAT, LON)} AS hop
        FROM (
            SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon
            FROM (SELECT *, (floor((epoch(ts) - 1) / 86400) + 1) * 86400000 + 1000 AS window_end_ms
                  FROM points)
            WINDOW w AS (PARTITION BY lp, window_end_ms ORDER BY ts, lat, lon)
        )
    ) GROUP BY 1, 2"""


def _rounded_points(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.round(F.col(c).cast("double"), 5) for c in ("lat", "lon")}
    )


ROUNDED = "round(CAST(lat AS DOUBLE), 5) AS lat, round(CAST(lon AS DOUBLE), 5) AS lon"


@query(
    "points_within_radius",
    with_tables(
        "lattice points",
        f""" SELECT event_id, lp, {ROUNDED} FROM points
             WHERE {sql_distance(*CENTRE, LAT, LON)} <= 1000""",
    ),
)
def points_within_radius(spark: SparkSession, sf: str) -> DataFrame:
    near = traffic.within_radius(t.points(t.events(spark, sf)))
    return _rounded_points(near.select("event_id", "lp", "lat", "lon"))


def _speeds(spark: SparkSession, sf: str) -> DataFrame:
    return traffic.avg_speed_windows(
        t.points(t.events(spark, sf)), UPDATE_MS, "1 day", "1 second", slice_seconds=6 * 3600
    )


def _speeds_out(df: DataFrame) -> DataFrame:
    return _rounded_points(
        df.select(
            F.unix_millis("window_end").alias("window_end_ms"), "lp", "lat", "lon", "avg_speed"
        )
    )


@query(
    "avg_speed_windows",
    with_tables("lattice points", f" SELECT window_end_ms, lp, {ROUNDED}, avg_speed FROM ({SPEEDS})"),
)
def avg_speed_windows(spark: SparkSession, sf: str) -> DataFrame:
    return _speeds_out(_speeds(spark, sf))


@query(
    "speeding",
    with_tables(
        "lattice points", f" SELECT window_end_ms, lp, avg_speed FROM ({SPEEDS}) WHERE avg_speed >= 40"
    ),
)
def speeding(spark: SparkSession, sf: str) -> DataFrame:
    return _speeds_out(traffic.speeding(_speeds(spark, sf))).drop("lat", "lon")


@query(
    "encode_traffic_notice",
    with_tables(
        "lattice points",
        f""" SELECT '{{ts: ' || CAST(window_end_ms AS VARCHAR) || ', lp: ''' || lp || ''', lat: '
                    || printf('%.6f', CAST(lat AS DOUBLE)) || ', long: '
                    || printf('%.6f', CAST(lon AS DOUBLE)) || ', avgSpeed: '
                    || CAST(avg_speed AS VARCHAR) || '}}' AS value
             FROM ({SPEEDS})""",
    ),
)
def encode_traffic_notice(spark: SparkSession, sf: str) -> DataFrame:
    return codecs.encode_traffic_notice(_speeds(spark, sf))


LEGS = f"""
    SELECT *, {sql_distance("lat0", "lon0", "lat1", "lon1")} AS length FROM (
        SELECT lp, event_id AS seq, CAST(lat AS DOUBLE) AS lat1, CAST(lon AS DOUBLE) AS lon1,
               CAST(lag(lat) OVER w AS DOUBLE) AS lat0, CAST(lag(lon) OVER w AS DOUBLE) AS lon0,
               10 + CAST(floor(value) AS BIGINT) % 70 AS speed
        FROM points WINDOW w AS (PARTITION BY lp ORDER BY event_id)
    ) WHERE lat0 IS NOT NULL"""


@query(
    "densify_trajectory",
    with_tables(
        "lattice points",
        f""" SELECT lp, seq, j, round(CAST(CAST(lat0 + share * (lat1 - lat0) AS FLOAT) AS DOUBLE), 4) AS lat,
                    round(CAST(CAST(lon0 + share * (lon1 - lon0) AS FLOAT) AS DOUBLE), 4) AS lon,
                    CAST((upto - n + j) * 60000 AS BIGINT) AS ts_ms
             FROM (
                SELECT *, CASE WHEN j = 0 THEN 0 ELSE j * stride / length END AS share
                FROM (SELECT *, unnest(generate_series(0, n - 1)) AS j
                      FROM (SELECT *, sum(n) OVER (PARTITION BY lp ORDER BY seq) AS upto
                            FROM (SELECT *, (speed / 3.6::DOUBLE) * 60 AS stride,
                                         CAST(ceil(length / ((speed / 3.6::DOUBLE) * 60)) AS BIGINT) AS n
                                  FROM ({LEGS})))
                      WHERE n > 0)
             )""",
    ),
)
def densify_trajectory(spark: SparkSession, sf: str) -> DataFrame:
    way = t.points(t.events(spark, sf)).select(
        "lp",
        F.col("event_id").alias("seq"),
        "lat",
        "lon",
        (10 + F.floor("value") % 70).alias("speed"),
    )
    legs = traffic.legs(way)
    dense = traffic.densify_trajectory(legs, 60000, F.lit(0).cast("bigint"))
    return dense.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("lat", "lon")})


@query(
    "road_segments",
    with_tables(
        "lattice",
        f""", nodes AS (
               SELECT DISTINCT CAST(k AS VARCHAR) || '-' || CAST(m AS VARCHAR) AS id,
                      CAST(52.50 AS DOUBLE) + k * CAST(0.0003 AS DOUBLE) AS lat,
                      CAST(13.37 AS DOUBLE) + m * CAST(0.000003 AS DOUBLE) AS lon
               FROM lattice),
             edges AS (
               SELECT lag(CAST(k AS VARCHAR) || '-' || CAST(m AS VARCHAR))
                        OVER (PARTITION BY user_id ORDER BY event_id) AS source,
                      CAST(k AS VARCHAR) || '-' || CAST(m AS VARCHAR) AS target
               FROM lattice)
            SELECT source, target, round({sql_distance("a.lat", "a.lon", "b.lat", "b.lon")}, 2) AS metres
            FROM edges JOIN nodes a ON source = a.id JOIN nodes b ON target = b.id""",
    ),
)
def road_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.events(spark, sf)
    k, m = t.lattice()
    stops = rows.select("user_id", "event_id", F.concat_ws("-", k, m).alias("target"))
    linked = running(
        stops,
        ["user_id"],
        ["event_id"],
        time_slice(F.col("event_id"), 65536),
        {"source": ("lag", F.col("target"))},
    )
    edges = linked.filter(F.col("source").isNotNull()).select("source", "target")
    segments = traffic.road_segments(t.lattice_nodes(rows), edges)
    return segments.select("source", "target", F.round("metres", 2).alias("metres"))


# --- event-time lag --------------------------------------------------------------------


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Events arrive `value` seconds after they happened, at one of four tasks."""
    micros = F.unix_micros("ts") + F.round(F.col("value") * 1_000_000).cast("bigint")
    return t.events(spark, sf).select(
        "event_id",
        (F.col("user_id") % 4).alias("task"),
        "ts",
        F.timestamp_micros(micros).alias("arrival"),
    )


@query(
    "event_time_lag",
    """SELECT event_id, round((CAST(round(value * 1000000) AS BIGINT) + epoch_us(ts)
              - (epoch_us(date_trunc('hour', ts)) + 3600000000)) / 1000.0, 3) AS lag_ms
       FROM events""",
)
def event_time_lag(spark: SparkSession, sf: str) -> DataFrame:
    window_end = F.window("ts", "1 hour")["end"]
    rows = _arrivals(spark, sf).withColumn("window_end", window_end)
    lagged = telemetry.event_time_lag(rows, F.col("window_end"), F.col("arrival"))
    return lagged.select("event_id", F.round("lag_ms", 3).alias("lag_ms"))


@query(
    "lag_quantile",
    """SELECT user_id % 4 AS task, event_id,
              round(quantile_cont(value * 1000, 0.95) OVER (
                PARTITION BY user_id % 4 ORDER BY ts, event_id
                ROWS BETWEEN 499 PRECEDING AND CURRENT ROW), 4) AS lag_quantile
       FROM events""",
)
def lag_quantile(spark: SparkSession, sf: str) -> DataFrame:
    rows = _arrivals(spark, sf)
    lagged = telemetry.event_time_lag(rows, F.col("ts"), F.col("arrival"))
    rolled = telemetry.lag_quantile(
        lagged, ["task"], ["ts", "event_id"], time_slice(epoch(F.col("ts")), 3600)
    )
    return rolled.select("task", "event_id", F.round("lag_quantile", 4).alias("lag_quantile"))


# --- curves ----------------------------------------------------------------------------


@query(
    "every_nth_sample",
    """SELECT user_id, event_id FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
       WHERE i % 7 = 0""",
)
def every_nth_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.events(spark, sf).select("user_id", "event_id", "ts")
    return series.every_nth(rows, 7, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query(
    "resample_series",
    """SELECT user_id, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) - 1 AS j FROM events)
       WHERE j % 5 = 0 AND j / 5 < 8""",
)
def resample_series(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.events(spark, sf).select("user_id", "event_id", "ts", "value")
    kept = series.resample(rows, 5, 8, keys=["user_id"])
    return kept.select("user_id", "event_id", "value")


@query(
    "resample_from_anchor",
    """SELECT user_id, event_id FROM (
         SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) - 1 AS j
         FROM events e JOIN (SELECT user_id, max(ts) AS anchor FROM events
                             WHERE event_type = 'purchase' GROUP BY 1) a USING (user_id)
         WHERE ts <= anchor)
       WHERE j % 3 = 0""",
)
def resample_from_anchor(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.events(spark, sf)
    anchors = (
        rows.filter(F.col("event_type") == "purchase")
        .groupBy("user_id")
        .agg(F.max("ts").alias("anchor"))
    )
    kept = series.resample(rows.select("user_id", "event_id", "ts"), 3, anchors=anchors, keys=["user_id"])
    return kept.select("user_id", "event_id")


@query(
    "observation_at",
    """SELECT event_id, user_id, value FROM events
       WHERE ts = (SELECT ts FROM events ORDER BY value DESC, event_id LIMIT 1)""",
)
def observation_at(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.table(spark, sf, "events")  # times as they are stored, so that the scan can skip
    peak = rows.agg(F.max_by("ts", F.struct("value", -F.col("event_id")))).scalar()
    return series.observation_at(rows, peak).select("event_id", "user_id", "value")


@query(
    "rescale_curve",
    """WITH h AS (SELECT user_id, date_trunc('day', ts) AS ts, CAST(count(*) AS DOUBLE) AS v
                  FROM events GROUP BY 1, 2),
            b AS (SELECT user_id, min(v) AS lo, max(v) AS hi, greatest(count(*) // 10, 1) AS n
                  FROM h GROUP BY 1)
       SELECT user_id, CAST(epoch(ts) AS BIGINT) AS second,
              CAST(trunc((v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 150000) AS BIGINT) AS v
       FROM (SELECT h.*, lo, hi, n,
                    row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i
             FROM h JOIN b USING (user_id))
       WHERE i % n = 0""",
)
def rescale_curve(spark: SparkSession, sf: str) -> DataFrame:
    daily = (
        t.events(spark, sf)
        .groupBy("user_id", F.date_trunc("day", "ts").alias("ts"))
        .agg(F.count(F.lit(1)).cast("double").alias("v"))
    )
    curve = series.rescale_curve(daily, "v", 150000, 10, ["user_id"])
    return curve.select("user_id", F.unix_seconds("ts").alias("second"), "v")


@query(
    "workload_curve",
    """SELECT event_id AS second,
              CAST(trunc(30000 * sin(2 * pi() * 3 / (SELECT count(*) FROM events) * event_id)
                   + 30000 + 5000) AS BIGINT) AS count
       FROM events""",
)
def workload_curve(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.events(spark, sf).select("event_id")
    points = rows.agg(F.count(F.lit(1))).scalar()
    return rows.select(
        F.col("event_id").alias("second"),
        series.sine_curve(F.col("event_id"), points, 60000, 3, 5000).alias("count"),
    )


@query(
    "expand_rate_curve",
    """WITH c AS (SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS second, count(*) AS n
                  FROM events GROUP BY 1)
       SELECT second, i, (second * 31 + i) % 1000 AS ad,
              ['view', 'click', 'purchase'][(second * 31 + i) % 3 + 1] AS et
       FROM (SELECT second, unnest(generate_series(0, n - 1)) AS i FROM c)""",
)
def expand_rate_curve(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.unix_seconds(F.date_trunc("hour", "ts"))
    curve = t.events(spark, sf).groupBy(hour.alias("second")).count()
    return series.expand_rate_curve(curve)


# --- streaming forms -------------------------------------------------------------------


def _run(spark: SparkSession, df: DataFrame, mode: str) -> str:
    """Drain a streaming query into the shared folder and return the table's path."""
    root = session.shared_dir(spark, "stream")
    jobs.run_to_end(
        sinks.start_table(df, f"{root}/rows", f"{root}/checkpoint", mode, {"availableNow": True})
    )
    return f"{root}/rows"


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    session.configure(spark)
    return t.with_instants(streams.read_table_stream(spark, f"{sf}/events.parquet"))


@query("stream_campaign_counts", with_tables("ad_events campaigns", COUNTS))
def stream_campaign_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.ad_events(_event_stream(spark, sf))
    counts = ads.campaign_window_counts_stream(rows, t.campaigns(spark, sf), "1 hour")
    path = _run(spark, counts, "update")
    return _counts_out(sinks.read_changelog(spark, path, ["campaign_id", "window_end"]))


@query(
    "stream_avg_speed",
    with_tables("lattice points", f" SELECT window_end_ms, lp, {ROUNDED}, avg_speed FROM ({SPEEDS})"),
)
def stream_avg_speed(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.points(_event_stream(spark, sf))
    speeds = traffic.avg_speed_windows_stream(rows, UPDATE_MS, "1 day", "1 second")
    path = _run(spark, speeds, "update")
    return _speeds_out(sinks.read_changelog(spark, path, ["window_end", "lp"]))


def _stream_words(dialect: str, mode: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        session.configure(spark)
        lines = streams.read_table_stream(spark, f"{sf}/documents.parquet")
        path = _run(spark, words.word_count(lines, "text", dialect), mode)
        if mode == "complete":
            return sinks.read_snapshot(spark, path)
        return sinks.read_changelog(spark, path, ["word"])

    return run


query("stream_word_count_words", WORDS)(_stream_words("words", "update"))
query("stream_word_count_spaces", SPACES)(_stream_words("spaces", "complete"))
query("stream_word_count_changelog", CHANGELOG)(_stream_words("changelog", "update"))


# --- streams of many batches, with late rows -----------------------------------------------

# Every fortieth event arrives nine days late; a batch holds 1000 rows.
ROWS_PER_OFFSET, OFFSETS_PER_BATCH, DELAY = 250, 4, "1 day"
ARRIVED = f"""
    arrived AS (
        SELECT *, (row_number() OVER (ORDER BY arrival, event_id) - 1)
                  // {ROWS_PER_OFFSET} // {OFFSETS_PER_BATCH} AS batch
        FROM (SELECT *, ts + CASE WHEN event_id % 40 = 3 THEN INTERVAL 9 DAY ELSE INTERVAL 0 DAY END AS arrival
              FROM events)
    )"""


def _late(rows: str) -> str:
    """`late`: batches with the watermark that judges late rows, that of the batch before;
    `closing`: the last watermark of all. Watermarks are whole milliseconds."""
    return f"""
    late AS (
        SELECT batch, max(newest) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING)
                      - INTERVAL {DELAY} AS watermark
        FROM (SELECT batches.batch, date_trunc('milliseconds', max(ts)) AS newest
              FROM (SELECT DISTINCT batch FROM arrived) batches LEFT JOIN {rows} r ON r.batch = batches.batch
              GROUP BY ALL)),
    closing AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {DELAY} AS watermark FROM {rows})"""


def _replayed(spark: SparkSession, sf: str) -> DataFrame:
    """The events as they arrive: recorded once, then played back in batches."""
    rows = t.events(spark, sf)
    late = F.when(F.col("event_id") % 40 == 3, F.make_dt_interval(F.lit(9))).otherwise(F.make_dt_interval(F.lit(0)))
    path = session.shared_dir(spark, "recording")
    replay.record(rows.withColumn("arrival", F.col("ts") + late), path, "arrival", ["event_id"], ROWS_PER_OFFSET)
    return replay.read_replay(spark, path, maxOffsetsPerTrigger=str(OFFSETS_PER_BATCH))


NEXT = {"processingTime": "0 seconds"}
# As many state tasks as a batch has offsets: a batch of 1000 rows is no work for more.
STATE_TASKS = OFFSETS_PER_BATCH


def _drain(spark: SparkSession, df: DataFrame) -> str:
    """Append-mode rows of all batches, below the shared folder."""
    root = session.shared_dir(spark, "stream")
    jobs.run_until_idle(sinks.start_table(df, f"{root}/rows", f"{root}/checkpoint", "append", NEXT, STATE_TASKS))
    return f"{root}/rows"


@query(
    "replay_campaign_counts",
    with_tables(
        "campaigns",
        f""", {ARRIVED.lstrip()},
            seen AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end
                     FROM arrived WHERE event_type = 'view'),
            {_late("seen").lstrip()}
            SELECT coalesce(campaign_id, 'UNKNOWN') AS campaign_id, count(*) AS ct,
                   CAST(epoch_ms(window_end) AS BIGINT) AS window_end_ms
            FROM seen JOIN late USING (batch) LEFT JOIN campaigns ON ad_id = CAST(user_id AS VARCHAR)
            WHERE (late.watermark IS NULL OR window_end > late.watermark)
              AND window_end <= (SELECT watermark FROM closing)
            GROUP BY ALL""",
    ),
)
def replay_campaign_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Closed campaign windows of a stream of many batches with late events."""
    rows = t.ad_events(_replayed(spark, sf))
    counts = ads.campaign_window_counts_stream(rows, t.campaigns(spark, sf), "1 hour", DELAY)
    return _counts_out(sinks.read_rows(spark, _drain(spark, counts)))


@query(
    "replay_campaign_notices",
    f"""SELECT '{{"id":"' || campaign_id || '","ct":' || CAST(ct AS VARCHAR) || ',"ts":'
               || CAST(window_end_ms AS VARCHAR) || '}}' AS value
        FROM ({ORACLES["replay_campaign_counts"]})""",
)
def replay_campaign_notices(spark: SparkSession, sf: str) -> DataFrame:
    """The same windows as messages, each delivered once."""
    rows = t.ad_events(_replayed(spark, sf))
    counts = ads.campaign_window_counts_stream(rows, t.campaigns(spark, sf), "1 hour", DELAY)
    lines = codecs.encode_campaign_counts(counts).select("value")
    root = session.shared_dir(spark, "notices")
    jobs.run_until_idle(
        epoch_log.start_exactly_once(lines, f"{root}/log", f"{root}/checkpoint", trigger=NEXT, partitions=STATE_TASKS)
    )
    return epoch_log.read_exactly_once(spark, f"{root}/log", lines.schema)


@query(
    "replay_campaign_table",
    with_tables(
        "campaigns",
        f""", {ARRIVED.lstrip()},
            seen AS (SELECT *, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end
                     FROM arrived WHERE event_type = 'view'),
            {_late("seen").lstrip()}
            SELECT coalesce(campaign_id, 'UNKNOWN') AS campaign_id, count(*) AS ct,
                   CAST(epoch_ms(window_end) AS BIGINT) AS window_end_ms
            FROM seen JOIN late USING (batch) LEFT JOIN campaigns ON ad_id = CAST(user_id AS VARCHAR)
            WHERE late.watermark IS NULL OR window_end > late.watermark
            GROUP BY ALL""",
    ),
)
def replay_campaign_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts, open windows included, as a table that every batch updates."""
    rows = t.ad_events(_replayed(spark, sf))
    counts = ads.campaign_window_counts_stream(rows, t.campaigns(spark, sf), "1 hour", DELAY)
    root, keys = session.shared_dir(spark, "upserts"), ["campaign_id", "window_end"]
    jobs.run_until_idle(
        upserts.start_upserts(counts, f"{root}/table", f"{root}/checkpoint", keys, NEXT, STATE_TASKS)
    )
    return _counts_out(upserts.read_upserts(spark, f"{root}/table", keys))


_ON_TIME = f"""{ARRIVED.lstrip()}, {_late("arrived").lstrip()},
    on_time AS (SELECT a.* FROM arrived a JOIN late USING (batch)
                WHERE late.watermark IS NULL OR ts > late.watermark)"""


def _replayed_speeds(spark: SparkSession, sf: str) -> DataFrame:
    points = t.points(_replayed(spark, sf))
    return traffic.closed_speed_windows_stream(
        points, UPDATE_MS, "1 day", "1 second", delay=DELAY, slice_width="6 hours"
    )


@query(
    "replay_avg_speed",
    with_tables(
        "lattice points",
        f" SELECT window_end_ms, lp, {ROUNDED}, avg_speed FROM ({SPEEDS})"
        " WHERE window_end_ms <= (SELECT epoch_ms(watermark) FROM closing)",
    )
    .replace("FROM events", "FROM on_time", 1)
    .replace("WITH RECURSIVE ", f"WITH RECURSIVE {_ON_TIME}, ", 1),
)
def replay_avg_speed(spark: SparkSession, sf: str) -> DataFrame:
    """Closed speed windows of a stream of many batches with late positions."""
    return _speeds_out(sinks.read_rows(spark, _drain(spark, _replayed_speeds(spark, sf))))


@query(
    "replay_late_rows",
    f"""WITH {_ON_TIME}
        SELECT (SELECT count(DISTINCT batch) FROM arrived) AS batches, (SELECT count(*) FROM arrived) AS n_rows,
               (SELECT count(*) FROM arrived) - (SELECT count(*) FROM on_time) AS dropped""",
)
def replay_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """What the progress telemetry says of that stream: batches, rows, and late rows dropped."""
    path = session.shared_dir(spark, "progress")
    speeds = _replayed_speeds(spark, sf)
    with progress.recorded(spark, path) as table:
        _drain(spark, speeds)
    value = F.sum("value")
    told = table.samples().groupBy("ts", "metric").agg(value.alias("value"))
    gauge = lambda name: F.when(F.col("metric") == name, F.col("value"))
    return told.agg(
        F.count(F.when(gauge("numInputRows") > 0, 1)).alias("batches"),
        F.sum(gauge("numInputRows")).cast("long").alias("n_rows"),
        F.sum(gauge("numRowsDroppedByWatermark")).cast("long").alias("dropped"),
    )
