"""Workload forecasts per control loop and their accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens.operators.regression import LOOPS_PER_SLICE
from loadlens.operators.scan import running

# Accuracy limits, streak length and horizons (steps).
GOOD_WAPE = 0.10
USABLE_WAPE = 0.25
RETRAIN_AFTER = 15
TREND_HORIZON = 600
MODEL_HORIZON = 900


def trend_lines(workload: DataFrame, step: int = 1) -> DataFrame:
    """Least-squares line of each loop's workload over the row position 0..n-1."""
    in_loop = Window.partitionBy("job", "loop").orderBy("ts")
    return (
        workload.withColumn("x", F.row_number().over(in_loop) - 1)
        .groupBy("job", "loop")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.regr_slope("workload", "x").alias("slope"),
            F.regr_intercept("workload", "x").alias("intercept"),
            (F.max("ts") + F.make_dt_interval(secs=F.lit(step))).alias("start"),
        )
    )


def forecast_trend(workload: DataFrame, horizon: int = TREND_HORIZON, step: int = 1) -> DataFrame:
    """Continue each loop's line for `horizon` steps: array `forecast`, first step at `start`."""
    ahead = F.sequence(F.col("n"), F.col("n") + (horizon - 1))
    return trend_lines(workload, step).withColumn(
        "forecast", F.transform(ahead, lambda x: F.col("slope") * x + F.col("intercept"))
    )


def forecast_rows(forecasts: DataFrame, step: int = 1, steps: int | None = None) -> DataFrame:
    """One row per forecast step, optionally the first `steps` only."""
    values = F.col("forecast") if steps is None else F.slice("forecast", 1, steps)
    return forecasts.select("job", "loop", "start", F.posexplode(values).alias("idx", "yhat")).select(
        "job",
        "loop",
        "idx",
        (F.col("start") + F.make_dt_interval(secs=F.col("idx") * step)).alias("ts"),
        "yhat",
    )


def wape(workload: DataFrame, forecasts: DataFrame, step: int = 1) -> DataFrame:
    """Accuracy, at each loop, of the latest forecast made before it.

    `sum |y - f| / sum y` over the timestamps both have; infinite without any. A loop's workload
    is gathered into its one row, which the forecast is joined to, so the whole overlap counts,
    and neither a step is unfolded nor a forecast repeated.
    """
    loops = workload.groupBy("job", "loop").agg(
        F.collect_list(F.struct(F.unix_micros("ts").alias("at"), F.col("workload").alias("y"))).alias("seen")
    )
    slices: Column = F.floor(F.col("loop") / LOOPS_PER_SLICE)
    numbers = workload.select("job", "loop").distinct()
    linked = running(numbers, ["job"], ["loop"], slices, {"__before": ("lag", F.col("loop"))})
    made = forecasts.select("job", F.col("loop").alias("__before"), "start", "forecast")
    known = loops.join(linked, ["job", "loop"]).join(made, ["job", "__before"], "left")
    width = F.lit(step * 1_000_000).cast("bigint")

    def met(row: Column) -> Column:
        micros = row["at"] - F.unix_micros("start")
        at = F.when((micros >= 0) & (micros % width == 0), F.floor(micros / width).cast("int"))
        yhat = F.when(at.isNotNull(), F.get("forecast", at))
        return F.struct(row["y"].alias("y"), yhat.alias("yhat"))

    pairs = F.filter(F.transform("seen", met), lambda p: p["yhat"].isNotNull())
    scored = known.select("job", "loop", F.coalesce(pairs, F.array()).alias("pairs"))

    def added(value: Column) -> Column:
        return F.aggregate(value, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))

    error = added(F.transform("pairs", lambda p: F.abs(p["y"] - p["yhat"])))
    total = added(F.transform("pairs", lambda p: p["y"].cast("double")))
    return scored.select(
        "job",
        "loop",
        F.size("pairs").cast("bigint").alias("overlap"),
        F.coalesce(
            F.when(F.size("pairs") > 0, F.try_divide(error, total)), F.lit(float("inf"))
        ).alias("wape"),
    )


def choose_forecast(model: DataFrame, trend: DataFrame, accuracy: DataFrame) -> DataFrame:
    """The model's forecast where its last accuracy is good enough, else the trend."""
    keys = ["job", "loop"]
    sides = (
        trend.select(*keys, F.col("forecast").alias("__trend"), F.col("start"))
        .join(model.select(*keys, F.col("forecast").alias("__model")), keys, "left")
        .join(accuracy.select(*keys, "wape"), keys, "left")
    )
    use_model = (F.coalesce("wape", F.lit(float("inf"))) < USABLE_WAPE) & F.col("__model").isNotNull()
    return sides.select(
        *keys,
        "start",
        "wape",
        F.when(use_model, "model").otherwise("trend").alias("source"),
        F.when(use_model, F.col("__model")).otherwise(F.col("__trend")).alias("forecast"),
    )


def bad_streaks(accuracy: DataFrame, after: int = RETRAIN_AFTER) -> DataFrame:
    """Consecutive bad forecasts up to each loop, and whether to fit the model again.

    Loops without overlap neither raise nor reset the streak.
    """
    scored = F.col("overlap") > 0
    good = scored & (F.col("wape") < GOOD_WAPE)
    bad = F.when(scored & ~good, 1).otherwise(0)
    slices: Column = F.floor(F.col("loop") / LOOPS_PER_SLICE)
    counted = running(accuracy, ["job"], ["loop"], slices, {"__bad": ("sum", bad)})
    marked = running(
        counted, ["job"], ["loop"], slices, {"__at_good": ("last", F.when(good, F.col("__bad")))}
    )
    streak = F.col("__bad") - F.coalesce("__at_good", F.lit(0))
    return marked.withColumn("bad_streak", streak).withColumn(
        "needs_retrain", F.col("bad_streak") >= after
    ).drop("__bad", "__at_good")
