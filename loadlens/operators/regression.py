"""Per-pod load lines (cpu -> throughput), updated once per control loop.

The update of loop l with k samples, n samples so far and the means m of the loops before it
adds `(n-1)/n * sum((x - m)^2)` to `n * v` (and likewise for the covariance). The model is
therefore a running sum over loops: samples are reduced to one row per loop first, and
histories of any length need neither a sequential fold nor a collected list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens.operators.scan import running

POD = ("job", "pod")
LOOPS_PER_SLICE = 4096


def loop_moments(samples: DataFrame, keys: Sequence[str] = POD) -> DataFrame:
    """One row per pod and loop: size, means and centred sums of `cpu` and `throughput`."""
    return samples.groupBy(*keys, "loop").agg(
        F.count(F.lit(1)).alias("k"),
        F.avg("cpu").alias("mx"),
        F.avg("throughput").alias("my"),
        (F.var_pop("cpu") * F.count(F.lit(1))).alias("sxx"),
        (F.covar_pop("cpu", "throughput") * F.count(F.lit(1))).alias("sxy"),
    )


def with_sessions(loops: DataFrame, keys: Sequence[str] = POD) -> DataFrame:
    """Add `session` to one row per pod and loop: constant over consecutive loops.

    A pod that is absent for a loop loses its model; its next loop opens a new session. The
    loop number less the row number only changes at such gaps.
    """
    slices = F.floor(F.col("loop") / LOOPS_PER_SLICE)
    numbered = running(loops, keys, ["loop"], slices, {"__pos": ("pos", F.lit(1))})
    return numbered.withColumn("session", F.col("loop") - F.col("__pos")).drop("__pos")


def fold_lines(moments: DataFrame, keys: Sequence[str] = (*POD, "session")) -> DataFrame:
    """Add the line of every pod after each loop: `n, mean_x, mean_y, slope, intercept`.

    Takes the columns of `loop_moments`; loops with `k = 0` keep the state as it is.
    """
    keys = list(keys)
    slices = F.floor(F.col("loop") / LOOPS_PER_SLICE)
    x, y, sxx, sxy = (F.coalesce(c, F.lit(0.0)) for c in ("mx", "my", "sxx", "sxy"))
    k = F.col("k")
    totals = running(
        moments,
        keys,
        ["loop"],
        slices,
        {"n": ("sum", k), "__sx": ("sum", k * x), "__sy": ("sum", k * y)},
    )
    before = F.col("n") - k
    dx = x - F.when(before > 0, (F.col("__sx") - k * x) / before).otherwise(0.0)
    dy = y - F.when(before > 0, (F.col("__sy") - k * y) / before).otherwise(0.0)
    shrink = F.when(F.col("n") > 0, (F.col("n") - 1) / F.col("n")).otherwise(0.0)
    sums = running(
        totals,
        keys,
        ["loop"],
        slices,
        {
            "__v": ("sum", F.when(k > 0, shrink * (sxx + k * dx * dx)).otherwise(0.0)),
            "__c": ("sum", F.when(k > 0, shrink * (sxy + k * dx * dy)).otherwise(0.0)),
        },
    )
    mean_x, mean_y = F.try_divide("__sx", "n"), F.try_divide("__sy", "n")
    slope = F.try_divide("__c", "__v")
    return sums.withColumns(
        {
            "mean_x": mean_x,
            "mean_y": mean_y,
            "slope": slope,
            "intercept": mean_y - slope * mean_x,
        }
    ).drop("__sx", "__sy", "__v", "__c")


def least_squares_lines(samples: DataFrame, keys: Sequence[str] = POD) -> DataFrame:
    """Ordinary least squares over the whole history of a pod."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("throughput", "cpu").alias("slope"),
        F.regr_intercept("throughput", "cpu").alias("intercept"),
    )


def regression_score(samples: DataFrame, lines: DataFrame, keys: Sequence[str] = POD) -> DataFrame:
    """Coefficient of determination of given lines on given samples."""
    fitted = samples.join(lines.select(*keys, "slope", "intercept"), list(keys))
    error = F.col("throughput") - (F.col("slope") * F.col("cpu") + F.col("intercept"))
    return (
        fitted.groupBy(*keys)
        .agg(
            F.sum(error * error).alias("sse"),
            (F.var_pop("throughput") * F.count(F.lit(1))).alias("sst"),
        )
        .select(*keys, (1 - F.try_divide("sse", "sst")).alias("r2"))
    )
