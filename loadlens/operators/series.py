"""Reshaping of `(series, ts, value)` curves: thinning, lookup, scaling, expansion."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.scan import epoch, running, time_slice

SLICE_SECONDS = 86400
EVENTS_PER_BLOCK = 10000
# Fixed values of generated ad events.
EVENT_TYPES = ("view", "click", "purchase")


def _numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column | None
) -> DataFrame:
    slice_by = time_slice(epoch(F.col(order[0])), SLICE_SECONDS) if slice_by is None else slice_by
    return running(df, keys, order, slice_by, {"__pos": ("pos", F.lit(1))})


def every_nth(
    df: DataFrame,
    n: int | Column,
    keys: Sequence[str] = ("series",),
    order: Sequence[str] = ("ts",),
    slice_by: Column | None = None,
) -> DataFrame:
    """First row of each series and every n-th one after it."""
    return (
        _numbered(df, keys, order, slice_by)
        .filter((F.col("__pos") - 1) % n == 0)
        .drop("__pos")
    )


def resample(
    df: DataFrame,
    rate: int,
    limit: int | None = None,
    anchors: DataFrame | None = None,
    keys: Sequence[str] = ("series",),
    slice_by: Column | None = None,
) -> DataFrame:
    """Walk back from an anchor, keep every `rate`-th row and at most `limit` of them.

    `anchors` holds one `anchor` timestamp per series, which must hit a row exactly; series
    without one, or whose anchor is missing, yield nothing. Without `anchors` the last row
    of each series is meant. `ts` must be unique within a series.
    """
    keys = list(keys)
    placed = _numbered(df, keys, ["ts"], slice_by)
    if anchors is None:
        ends = placed.groupBy(*keys).agg(F.max("__pos").alias("__end"))
    else:
        ends = (
            placed.join(anchors.withColumnRenamed("anchor", "ts"), [*keys, "ts"])
            .select(*keys, F.col("__pos").alias("__end"))
        )
    back = F.col("__end") - F.col("__pos")
    kept = placed.join(ends, keys).filter((back >= 0) & (back % rate == 0))
    if limit is not None:
        kept = kept.filter(back / rate < limit)
    return kept.drop("__pos", "__end")


def observation_at(df: DataFrame, ts: Column) -> DataFrame:
    """Rows at a point in time; a comparison on the stored column reaches the scan."""
    return df.filter(F.col("ts") == ts)


def sine_curve(
    index: Column, resolution: int | Column, amplitude: int, cycles: int, floor: int
) -> Column:
    """Whole-number sine load between `floor` and `floor + amplitude`."""
    x = F.lit(2 * math.pi * cycles) / resolution * index
    return (F.lit(amplitude / 2) * F.sin(x) + F.lit(amplitude / 2) + F.lit(floor)).cast("bigint")


def workload_curve(spark, points: int, amplitude: int, cycles: int, floor: int) -> DataFrame:
    """`second, count` rows of a sine load."""
    return spark.range(points).select(
        F.col("id").alias("second"),
        sine_curve(F.col("id"), points, amplitude, cycles, floor).alias("count"),
    )


def rescale_curve(
    df: DataFrame,
    value: str,
    top: float,
    points: int,
    keys: Sequence[str] = ("series",),
    order: Sequence[str] = ("ts",),
    slice_by: Column | None = None,
) -> DataFrame:
    """Scale each series to 0..`top`, thin it to about `points` rows, truncate."""
    keys = list(keys)
    bounds = df.groupBy(*keys).agg(
        F.min(value).alias("__lo"),
        F.max(value).alias("__hi"),
        F.greatest(F.floor(F.count(F.lit(1)) / points), F.lit(1)).alias("__every"),
    )
    span = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0)
    scaled = (F.col(value) - F.col("__lo")) / span * top
    return (
        every_nth(df.join(bounds, keys), F.col("__every"), keys, order, slice_by)
        .withColumn(value, scaled.cast("bigint"))
        .drop("__lo", "__hi", "__every")
    )


def expand_rate_curve(curve: DataFrame, ads: int = 1000) -> DataFrame:
    """`count` ad events at every `second` of a curve, with attributes fixed by position.

    Two explodes and an exchange between them: a burst second is produced by many tasks.
    """
    blocks = (
        curve.filter(F.col("count") > 0)
        .withColumn(
            "b",
            F.explode(
                F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / EVENTS_PER_BLOCK))
            ),
        )
        .repartition("second", "b")
    )
    first = F.col("b") * EVENTS_PER_BLOCK
    last = F.least(first + EVENTS_PER_BLOCK, F.col("count")) - 1
    seed = F.col("second") * 31 + F.col("i")
    types = F.array(*[F.lit(t) for t in EVENT_TYPES])
    return (
        blocks.withColumn("i", F.explode(F.sequence(first, last)))
        .select(
            "second",
            "i",
            (seed % ads).alias("ad"),
            F.get(types, (seed % len(EVENT_TYPES)).cast("int")).alias("et"),
        )
    )
