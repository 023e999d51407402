"""Workload / throughput residuals: moments, anomalies, observed recovery times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.scan import epoch, running, time_slice
from loadlens.operators.telemetry import align_outer

# Rows tolerated between groups of anomalies (fixed value).
GAP = 30


def residuals(workload: DataFrame, throughput: DataFrame) -> DataFrame:
    """`workload - throughput` on the union of both time axes, gaps read as 0."""
    both = align_outer(workload, throughput, ["workload", "throughput"])
    return both.withColumn("residual", F.col("workload") - F.col("throughput"))


def residual_moments(rows: DataFrame, keys: Sequence[str] = ("job",)) -> DataFrame:
    """Count, mean and population standard deviation of the training residuals."""
    return rows.groupBy(*keys).agg(
        F.count("residual").alias("n"),
        F.avg("residual").alias("mean"),
        F.stddev_pop("residual").alias("std"),
    )


def moments_before(rows: DataFrame, keys: Sequence[str] = ("job",)) -> DataFrame:
    """Moments that were known when each loop began: those of all residuals of earlier loops.

    Takes `(keys, loop, ts, residual)`, gives `(keys, loop, n, mean, std)`; mean and std are
    null for a series' first loop. Sums are taken around the first residual.
    """
    keys = list(keys)
    first = rows.groupBy(*keys).agg(F.min_by("residual", "ts").alias("origin"))
    x = F.col("residual") - F.col("origin")
    loops = rows.join(first, keys).groupBy(*keys, "loop", "origin").agg(
        F.count(x).alias("k"), F.sum(x).alias("s"), F.sum(x * x).alias("ss")
    )
    known = running(
        loops,
        keys,
        ["loop"],
        F.floor(F.col("loop") / 4096),
        {"__n": ("sum", F.col("k")), "__s": ("sum", F.col("s")), "__ss": ("sum", F.col("ss"))},
    )
    n = F.col("__n") - F.col("k")
    mean = F.try_divide(F.col("__s") - F.col("s"), n)
    spread = F.try_divide(F.col("__ss") - F.col("ss"), n) - mean * mean
    return known.select(
        *keys,
        "loop",
        n.alias("n"),
        (F.col("origin") + mean).alias("mean"),
        F.sqrt(F.when(spread < 0, 0.0).otherwise(spread)).alias("std"),
    )


def detect_anomalies(
    rows: DataFrame,
    moments: DataFrame,
    keys: Sequence[str] = ("job",),
    gap: int = GAP,
    slice_by: Column | None = None,
    as_of: Sequence[str] = (),
) -> DataFrame:
    """Flag residuals further than one deviation from the mean, smeared `gap` rows forward.

    `moments` has one row per series, or, with `as_of=("loop",)`, one per series and loop;
    rows without known moments are not flagged.

    A row is flagged when the latest raw anomaly lies at most `gap` rows back, so the
    rolling maximum needs two running positions and no frame of rows.
    """
    slice_by = time_slice(epoch(F.col("ts")), 86400) if slice_by is None else slice_by
    raw = F.abs(F.col("residual") - F.col("mean")) > F.col("std")
    on = [*keys, *as_of]
    scored = rows.join(moments.select(*on, "mean", "std"), on).withColumn(
        "raw", F.coalesce(raw, F.lit(False)).cast("int")
    )
    hit = F.col("raw") == 1
    placed = running(
        scored,
        keys,
        ["ts"],
        slice_by,
        {"pos": ("pos", hit), "last_hit": ("last_pos", hit), "prev_hit": ("prev_pos", hit)},
    )
    near = F.coalesce(F.col("pos") - F.col("last_hit") <= gap, F.lit(False))
    return placed.withColumn("anomaly", near.cast("int")).drop("last_hit", "mean", "std")


def anomaly_runs(
    flagged: DataFrame,
    keys: Sequence[str] = ("job",),
    gap: int = GAP,
    slice_rows: int = 65536,
) -> DataFrame:
    """Runs of flagged rows with their length less the smear; at least one row remains.

    Works on raw anomalies only: two of them share a run when at most `gap` unflagged rows
    would lie between their smears, i.e. when they are at most `gap + 1` rows apart.
    """
    hits = flagged.filter("raw = 1").select(*keys, "ts", "pos", "prev_hit")
    opens = F.col("prev_hit").isNull() | (F.col("pos") - F.col("prev_hit") > gap + 1)
    grouped = running(
        hits,
        keys,
        ["pos"],
        F.floor(F.col("pos") / slice_rows),
        {"run_pos": ("max", F.when(opens, F.col("pos")))},
    )
    sizes = flagged.groupBy(*keys).agg(F.max("pos").alias("rows"))
    length = F.least(F.col("last_pos") + gap, F.col("rows")) - F.col("run_pos") + 1
    return (
        grouped.groupBy(*keys, "run_pos")
        .agg(F.min("ts").alias("since"), F.max("pos").alias("last_pos"))
        .join(sizes, list(keys))
        .withColumn("excess", length - gap)
        .filter("excess > 0")
        .select(*keys, "since", "run_pos", "excess")
    )


def observed_recovery_time(
    flagged: DataFrame,
    keys: Sequence[str] = ("job",),
    gap: int = GAP,
    slice_rows: int = 65536,
) -> DataFrame:
    """Mean excess of the runs (0 without any), and whether the last row is clean again."""
    runs = anomaly_runs(flagged, keys, gap, slice_rows)
    mean = runs.groupBy(*keys).agg(
        F.avg("excess").alias("recovery_time"), F.count(F.lit(1)).alias("runs")
    )
    state = flagged.groupBy(*keys).agg(
        (F.max_by("anomaly", "pos") == 0).alias("recovered")
    )
    return state.join(mean, list(keys), "left").select(
        *keys,
        "recovered",
        F.coalesce("runs", F.lit(0)).alias("runs"),
        F.coalesce("recovery_time", F.lit(0.0)).alias("recovery_time"),
    )
