"""Scale-out decision for every job and control loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators import recovery
from loadlens.operators.scan import running

# Fixed values of the decision rule (seconds or steps).
STABILISE = 180
CALM = 600
TARGET_RECOVERY = 600
LOOP_STEPS = 60
INITIAL_AGE = 300


def _max_of_first(values: Column, n: Column) -> Column:
    return F.array_max(F.slice(values, F.lit(1), n))


def plan_scaleout(
    situations: DataFrame,
    up: Column | int = recovery.UP_DOWNTIME,
    down: Column | int = recovery.DOWN_DOWNTIME,
    stabilise: int = STABILISE,
    calm: int = CALM,
    target_recovery: int = TARGET_RECOVERY,
    loop_steps: int = LOOP_STEPS,
) -> DataFrame:
    """Add `target` (scale-out to run at) and `reason` to `(job, loop)` situations.

    A situation has `parallelism, capacities (array 0..max), forecast (array), avg_workload,
    tail_workload, lag, since_rescale`. The candidates are elements of the row's own array,
    tested by a filter on it, so a fleet is planned in one narrow projection. Every situation
    gets a decision; without a forecast (null or empty) the scale-out stays.
    """
    current = F.get("capacities", F.col("parallelism"))
    rows = situations.withColumns(
        {
            "__current": current,
            "__peak": F.array_max("forecast"),
            "__near_peak": _max_of_first(F.col("forecast"), F.lit(loop_steps)),
            "__lag": F.coalesce("lag", F.lit(0.0)),
        }
    )

    def acceptable(i: Column) -> Column:
        capacity = F.get("capacities", i)
        needed = recovery.recovery_time(
            i,
            capacity,
            F.col("__current"),
            F.col("parallelism"),
            F.col("forecast"),
            F.col("tail_workload"),
            F.col("lag"),
            up,
            down,
        )
        blocked = (i < F.col("parallelism")) & (F.col("__current") < F.col("__lag"))
        lasting = (i == F.col("parallelism")) | (~blocked & (capacity > F.col("__peak")))
        # The cheap tests come first; the walk over the forecast only runs behind them.
        return F.when(
            (capacity > F.col("avg_workload")) & lasting,
            F.coalesce(
                (needed <= target_recovery)
                & (capacity >= _max_of_first(F.col("forecast"), needed)),
                F.lit(False),
            ),
        ).otherwise(False)

    top = F.size("capacities") - 1
    found = F.get(F.filter(F.sequence(F.lit(0), top), acceptable), F.lit(0))
    waiting = F.col("since_rescale") < stabilise
    unknown = F.coalesce(F.col("__current"), F.lit(0)) == 0
    blind = F.get("forecast", F.lit(0)).isNull()
    steady = (
        (F.col("since_rescale") < calm)
        & (F.col("__current") > F.col("avg_workload"))
        & F.coalesce(F.col("__current") > F.col("__near_peak"), F.lit(False))
    )
    reason = (
        F.when(waiting, "stabilising")
        .when(unknown, "capacity unknown")
        .when(blind, "no forecast")
        .when(steady, "calm period")
        .when(F.col("__found").isNotNull(), "fits")
        .otherwise("maximum")
    )
    keep = waiting | unknown | blind | steady
    return (
        rows.withColumn("__found", F.when(~keep, found))
        .withColumn("reason", reason)
        .withColumn(
            "target", F.when(keep, F.col("parallelism")).otherwise(F.coalesce("__found", top))
        )
        .drop("__current", "__peak", "__near_peak", "__lag", "__found")
    )


def since_last_rescale(
    loops: DataFrame, loop_seconds: int, initial: int = INITIAL_AGE, slice_loops: int = 4096
) -> DataFrame:
    """Seconds since the parallelism last changed; a series starts `initial` seconds after."""
    slices = F.floor(F.col("loop") / slice_loops)
    linked = running(loops, ["job"], ["loop"], slices, {"__prev": ("lag", F.col("parallelism"))})
    changed = F.col("__prev").isNotNull() & (F.col("__prev") != F.col("parallelism"))
    marked = running(
        linked,
        ["job"],
        ["loop"],
        slices,
        {
            "__at": ("last", F.when(changed, F.col("loop"))),
            "__first": ("min", F.col("loop")),
        },
    )
    seconds = F.when(
        F.col("__at").isNotNull(), (F.col("loop") - F.col("__at")) * loop_seconds
    ).otherwise((F.col("loop") - F.col("__first")) * loop_seconds + initial)
    return marked.withColumn("since_rescale", seconds).drop("__prev", "__at", "__first")
