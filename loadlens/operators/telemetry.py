"""Alignment, filters and aggregates over metric samples.

Samples are long rows `(job, pod, metric, ts, value)`: the set of pods is data, not schema.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.scan import epoch, run_starts, running, time_slice, with_halo

SERIES = ("job", "pod", "metric")


# --- selection -------------------------------------------------------------------------


def select_series(
    samples: DataFrame, equal: dict[str, str] | None = None, regex: dict[str, str] | None = None
) -> DataFrame:
    """Label selectors: equality and fully anchored regular expressions."""
    for label, wanted in (equal or {}).items():
        samples = samples.filter(F.col(label) == wanted)
    for label, pattern in (regex or {}).items():
        samples = samples.filter(F.col(label).rlike(f"^(?:{pattern})$"))
    return samples


def drop_warm_up(rows: DataFrame, uptime: DataFrame, minimum_ms: int = 120000) -> DataFrame:
    """Remove timestamps at which the job had been up for less than `minimum_ms`."""
    young = uptime.filter(F.col("uptime") < minimum_ms).select("job", "ts").distinct()
    return rows.join(young, ["job", "ts"], "left_anti")


def is_number(column: str) -> Column:
    return F.col(column).isNotNull() & ~F.isnan(column)


def fill_gaps(df: DataFrame, *columns: str) -> DataFrame:
    """Missing values (null or NaN) become 0."""
    return df.withColumns({c: F.when(is_number(c), F.col(c)).otherwise(F.lit(0.0)) for c in columns})


# --- shapes ----------------------------------------------------------------------------


def metrics_wide(samples: DataFrame, metric: str, pods: Sequence[str] | None = None) -> DataFrame:
    """One column per pod. Name the pods when known: Spark then skips the lookup job."""
    chosen = samples.filter(F.col("metric") == metric).withColumn(
        "column", F.coalesce("pod", "metric")
    )
    pivot = chosen.groupBy("job", "ts").pivot("column", list(pods) if pods else None)
    return pivot.agg(F.first("value"))


def metrics_long(wide: DataFrame, ids: Sequence[str], metric: str) -> DataFrame:
    """Back from one column per pod to one row per pod; absent cells disappear."""
    pods = [c for c in wide.columns if c not in ids]
    return (
        wide.unpivot(list(ids), [F.col(f"`{p}`").cast("double").alias(p) for p in pods], "pod", "value")
        .filter(F.col("value").isNotNull())
        .withColumn("metric", F.lit(metric))
    )


def _floor_div(a: Column, b: int) -> Column:
    return ((a - F.pmod(a, F.lit(b))) / F.lit(b)).cast("bigint")


def metric_range(
    samples: DataFrame,
    start: int,
    stop: int,
    step: int = 1,
    lookback: int = 300,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Regular grid `start, start+step, ... stop` (epoch seconds) for every series.

    A grid point carries the latest sample at or before it, unless that is older than
    `lookback` seconds. No grid is laid out: every sample gives the points from itself up to
    the next sample, or to the end of its lookback.
    """
    micro = 1_000_000
    recent = samples.select(*SERIES, F.unix_micros("ts").alias("us"), "value").filter(
        F.col("us").between((start - lookback) * micro, stop * micro)
    )
    linked = running(
        recent,
        SERIES,
        ["us", "value"],
        time_slice(F.col("us") / F.lit(micro), max(slice_seconds, step)),
        {"next": ("lead", F.col("us"))},
    )
    since = F.col("us") - start * micro
    width = step * micro
    first = F.greatest(-_floor_div(-since, width), F.lit(0))
    within = F.least(since + lookback * micro, F.lit((stop - start) * micro))
    # The point of the next sample itself is that sample's.
    until = -_floor_div(-(F.col("next") - start * micro), width) - 1
    last = F.least(_floor_div(within, width), until)
    points = F.when(first <= last, F.sequence(first, last))
    return linked.withColumn("i", F.explode(points)).select(
        *SERIES, F.timestamp_seconds(F.lit(start) + F.col("i") * step).alias("ts"), "value"
    )


# --- alignment -------------------------------------------------------------------------


def align_inner(left: DataFrame, right: DataFrame, on: Sequence[str] = ("job", "pod", "ts")) -> DataFrame:
    """Rows present in both frames."""
    return left.join(right, list(on), "inner")


def align_outer(
    left: DataFrame, right: DataFrame, columns: Sequence[str], on: Sequence[str] = ("job", "ts")
) -> DataFrame:
    """Rows present in either frame; the other side's values become 0."""
    return fill_gaps(left.join(right, list(on), "full"), *columns)


# --- instant aggregates ----------------------------------------------------------------


def aggregate_by(samples: DataFrame, how: str, by: Sequence[str]) -> DataFrame:
    """`sum | avg | min | max | count` of the samples sharing the labels in `by`."""
    return samples.groupBy(*by).agg(getattr(F, how)("value").alias("value"))


def positive_sum(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum over the samples above zero."""
    return aggregate_by(samples.filter(F.col("value") > 0), "sum", by)


def latest_value(samples: DataFrame, by: Sequence[str] = ("job", "metric")) -> DataFrame:
    """Value of the newest sample."""
    return samples.groupBy(*by).agg(F.max_by("value", "ts").alias("value"))


def loop_workload(workload: DataFrame, by: Sequence[str] = ("job", "loop")) -> DataFrame:
    """Largest, mean and smallest workload of a loop, truncated to whole numbers."""
    return workload.groupBy(*by).agg(
        F.max("workload").cast("bigint").alias("max_workload"),
        F.avg("workload").cast("bigint").alias("avg_workload"),
        F.min("workload").cast("bigint").alias("min_workload"),
    )


def tail_sum(rows: DataFrame, value: str, n: int = 10, by: Sequence[str] = ("job",)) -> DataFrame:
    """Sum of the last `n` samples; the rank filter already thins rows before the shuffle."""
    newest = Window.partitionBy(*by).orderBy(F.col("ts").desc())
    return (
        rows.withColumn("__rank", F.row_number().over(newest))
        .filter(F.col("__rank") <= n)
        .groupBy(*by)
        .agg(F.sum(value).alias("tail_sum"))
    )


# --- values over time ------------------------------------------------------------------


def _reach(keys: Sequence[str], seconds: int, left_inclusive: bool = True):
    """The samples of one series slice that are in reach of each sample.

    Values are taken over these rows alone, never as a difference of two running values: NaN,
    infinite or very large samples have no effect once they are out of reach.
    """
    order = Window.partitionBy(*keys, "__slice").orderBy("__us")
    return order, order.rangeBetween(-(seconds * 1_000_000 - (0 if left_inclusive else 1)), 0)


def _sliced_samples(samples: DataFrame, seconds: int, slice_seconds: int) -> DataFrame:
    micros = samples.withColumn("__us", F.unix_micros("ts"))
    width = max(seconds, slice_seconds) * 1_000_000
    return with_halo(micros, F.col("__us"), width, seconds * 1_000_000)


def avg_over_time(
    samples: DataFrame,
    seconds: int = 60,
    left_inclusive: bool = True,
    keys: Sequence[str] = SERIES,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Mean of each series over the last `seconds`, at every sample; null values are skipped."""
    _, reach = _reach(keys, seconds, left_inclusive)
    return (
        _sliced_samples(samples, seconds, slice_seconds)
        .withColumn("avg_value", F.avg("value").over(reach))
        .filter("__own")
        .drop("__own", "__slice", "__us")
    )


def counter_rate(
    samples: DataFrame,
    seconds: int = 60,
    keys: Sequence[str] = SERIES,
    slice_seconds: int = 3600,
) -> DataFrame:
    """Per-second increase of a counter over the last `seconds`, at every sample.

    A drop means the counter restarted from zero. The increase is taken between the first
    and last sample in reach, without extrapolation to its edges; null for one sample, NaN
    where a sample in reach is NaN.
    `ts` must be unique within a series.
    """
    order, reach = _reach(keys, seconds)
    prev = F.lag("value").over(order)
    unknown = F.isnan("value") | F.isnan(prev)
    grown = (
        F.when(unknown, F.lit(float("nan")))
        .when(F.col("value") < prev, F.col("value"))
        .otherwise(F.col("value") - prev)
    )
    samples_in_reach = F.collect_list(F.struct("__us", "__inc")).over(reach)
    # The first sample in reach only starts the count; what it grew by lies before it.
    total = F.aggregate(
        F.slice("__seen", F.lit(2), F.size("__seen")), F.lit(0.0), lambda a, x: a + x["__inc"]
    )
    elapsed = (F.col("__us") - F.col("__seen")[0]["__us"]) / F.lit(1_000_000)
    return (
        _sliced_samples(samples, seconds, slice_seconds)
        .withColumn("__inc", F.coalesce(grown, F.lit(0.0)))
        .withColumn("__seen", samples_in_reach)
        .withColumn("rate", F.try_divide(total, elapsed))
        .filter("__own")
        .drop("__own", "__slice", "__us", "__inc", "__seen")
    )


def sustained(
    states: DataFrame,
    condition: Column,
    seconds: int,
    keys: Sequence[str] = ("job",),
    slice_seconds: int = 86400,
) -> DataFrame:
    """Stretches of consecutive rows on which `condition` held for at least `seconds`."""
    slices = time_slice(epoch(F.col("ts")), slice_seconds)
    runs = run_starts(states.withColumn("__on", condition), keys, ["ts"], slices, F.col("__on"))
    return (
        runs.filter("__on")
        .groupBy(*keys, "run")
        .agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
        .filter(F.unix_micros("until") - F.unix_micros("since") >= seconds * 1_000_000)
        .drop("run")
    )


def few_series_alert(
    samples: DataFrame, fewer_than: int = 2, seconds: int = 60, slice_seconds: int = 86400
) -> DataFrame:
    """Alert stretches: fewer than `fewer_than` series reported, for `seconds` or longer."""
    reporting = samples.groupBy("job", "ts").agg(F.count(F.lit(1)).alias("series"))
    return sustained(
        reporting, F.col("series") < fewer_than, seconds, ("job",), slice_seconds
    )


# --- latency ---------------------------------------------------------------------------


def event_time_lag(df: DataFrame, reference: Column, arrival: Column | None = None) -> DataFrame:
    """Milliseconds between an event-time reference and the arrival.

    Without an arrival column the clock is read, which on a stream is once per micro-batch.
    """
    arrival = F.current_timestamp() if arrival is None else arrival
    return df.withColumn(
        "lag_ms", (F.unix_micros(arrival) - F.unix_micros(reference)) / F.lit(1000)
    )


def lag_quantile(
    lags: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    quantile: float = 0.95,
    samples: int = 500,
    block_rows: int = 16384,
) -> DataFrame:
    """Quantile (linear interpolation) of `lag_ms` over the last `samples` rows of a key.

    Rows are numbered first, then cut into blocks of equal row count that repeat the
    `samples - 1` rows before them: no group exceeds that size, whatever the key's share.
    """
    keys = list(keys)
    numbered = running(lags, keys, order, slice_by, {"__pos": ("pos", F.lit(1))})
    blocks = with_halo(
        numbered.select(*keys, *order, "lag_ms", "__pos"), F.col("__pos"), block_rows, samples - 1
    )
    out = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in lags.select(*keys, *order, "lag_ms").schema
    )

    def roll(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("__pos")
        block["lag_quantile"] = (
            block["lag_ms"].rolling(samples, min_periods=1).quantile(quantile)
        )
        return block.loc[block["__own"], [*keys, *order, "lag_ms", "lag_quantile"]]

    return blocks.groupBy(*keys, "__slice").applyInPandas(roll, f"{out}, lag_quantile double")
