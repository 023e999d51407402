"""Predicted recovery time after a rescale, and feedback on the assumed downtimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.regression import LOOPS_PER_SLICE
from loadlens.operators.scan import running

# Fixed values, in steps: downtimes, checkpoint interval, and the stand-in for "longer than
# the forecast".
UP_DOWNTIME = 30
DOWN_DOWNTIME = 15
CHECKPOINT_INTERVAL = 10
BEYOND_FORECAST = 10800


def recovery_time(
    scaleout: Column,
    capacity: Column,
    current_capacity: Column,
    parallelism: Column,
    forecast: Column,
    tail_workload: Column,
    lag: Column,
    up: Column | int = UP_DOWNTIME,
    down: Column | int = DOWN_DOWNTIME,
) -> Column:
    """Steps until a job rescaled to `scaleout` has worked off its backlog.

    A row expression over the forecast array: no rows are multiplied and nothing moves.
    The restart is part of the crossing index and is added once more. Null where a
    capacity is unknown (0) or there is no forecast.
    """
    up, down = (F.lit(x) if isinstance(x, int) else x for x in (up, down))
    restart = F.when(scaleout < parallelism, down).otherwise(up).cast("int")
    while_down = F.aggregate(
        F.slice(forecast, F.lit(1), restart), F.lit(0.0), lambda a, y: a + y
    )
    backlog = (tail_workload + while_down + F.coalesce(lag, F.lit(0.0))).cast("bigint")
    walk = F.aggregate(
        F.slice(forecast, restart + 1, F.size(forecast)),
        F.struct(
            F.lit(0.0).alias("spare"),
            restart.alias("i"),
            F.lit(None).cast("int").alias("p"),
        ),
        lambda acc, y: F.struct(
            (acc["spare"] + F.greatest(capacity - y, F.lit(0.0))).alias("spare"),
            (acc["i"] + 1).alias("i"),
            F.coalesce(
                acc["p"],
                F.when(acc["spare"] + F.greatest(capacity - y, F.lit(0.0)) > backlog, acc["i"]),
            ).alias("p"),
        ),
    )
    return F.when(
        (capacity != 0) & (current_capacity != 0) & F.get(forecast, F.lit(0)).isNotNull(),
        F.coalesce(walk["p"], F.lit(BEYOND_FORECAST)) + restart,
    )


def predict_recovery(
    situations: DataFrame, up: Column | int = UP_DOWNTIME, down: Column | int = DOWN_DOWNTIME
) -> DataFrame:
    """Recovery time of every candidate scale-out.

    `situations` has one row per `(job, loop)` with `parallelism, capacities, forecast,
    tail_workload, lag`.
    """
    current = F.get("capacities", F.col("parallelism"))
    return (
        situations.withColumn("current_capacity", current)
        .select("*", F.posexplode("capacities").alias("scaleout", "capacity"))
        .select(
            "job",
            "loop",
            "parallelism",
            "scaleout",
            "capacity",
            recovery_time(
                F.col("scaleout"),
                F.col("capacity"),
                F.col("current_capacity"),
                F.col("parallelism"),
                F.col("forecast"),
                F.col("tail_workload"),
                F.col("lag"),
                up,
                down,
            ).alias("recovery_time"),
        )
    )


def adjust_downtime(
    rescales: DataFrame, up: int = UP_DOWNTIME, down: int = DOWN_DOWNTIME
) -> DataFrame:
    """Assumed downtime of a direction after each rescale of it: one step up when recovery
    took longer than predicted, else one step down."""
    change = F.when(F.col("observed") > F.col("predicted"), 1).otherwise(-1)
    base = F.when(F.col("direction") == "up", up).otherwise(down)
    moved = running(
        rescales,
        ["job", "direction"],
        ["loop"],
        F.floor(F.col("loop") / LOOPS_PER_SLICE),
        {"__shift": ("sum", change)},
    )
    return moved.withColumn("downtime", base + F.col("__shift")).drop("__shift")
