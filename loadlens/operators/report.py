"""Comparison of scaling approaches: resource use, latency and its distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.scan import running

ROWS_PER_BLOCK = 10000


def approach_means(rows: DataFrame, value: str, divisor: float = 1.0) -> DataFrame:
    """Mean per approach, optionally normalised (for instance by the largest scale-out)."""
    return rows.groupBy("approach").agg((F.avg(value) / divisor).alias(f"mean_{value}"))


def _value_slice(value: Column) -> Column:
    """Coarse monotone bucket of a number: a tenth of a percent wide, either side of zero.

    Null comes before all numbers, infinities and NaN (which Spark orders last) after them.
    """
    finite = F.floor(F.signum(value) * F.log1p(F.abs(value)) * 1024).cast("bigint")
    return (
        F.when(value.isNull(), -(1 << 62))
        .when(F.isnan(value), 1 << 62)
        .when(value == float("inf"), 1 << 61)
        .when(value == float("-inf"), -(1 << 61))
        .otherwise(finite)
    )


def ecdf_steps(rows: DataFrame, value: str) -> DataFrame:
    """Empirical distribution, one row per distinct value: ranks `first .. first + n - 1`.

    Equal values are counted before anything is ordered, so a value shared by most rows
    is a single row here.
    """
    counts = rows.groupBy("approach", value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("approach").agg(F.sum("n").alias("total"))
    ranked = running(
        counts, ["approach"], [value], _value_slice(F.col(value)), {"upto": ("sum", F.col("n"))}
    )
    return ranked.join(totals, "approach").select(
        "approach", value, "n", (F.col("upto") - F.col("n")).alias("first"), "total"
    )


def ecdf(rows: DataFrame, value: str) -> DataFrame:
    """Empirical distribution, one row per sample: `y = rank / total`, starting at 0."""
    steps = ecdf_steps(rows, value).withColumn(
        "b",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / ROWS_PER_BLOCK))),
    )
    start = F.col("b") * ROWS_PER_BLOCK
    stop = F.least(start + ROWS_PER_BLOCK, F.col("n")) - 1
    return (
        steps.repartition("approach", value, "b")
        .withColumn("i", F.explode(F.sequence(start, stop)))
        .select(
            "approach", value, ((F.col("first") + F.col("i")) / F.col("total")).alias("y")
        )
    )


def approach_report(wide_latency: DataFrame, wide_parallelism: DataFrame, divisor: float = 12.0) -> DataFrame:
    """Mean latency, mean parallelism and resource use of every approach.

    Inputs have `ts` and one column per approach; missing latency counts as 0, and an approach
    without any parallelism is left out.
    """

    def long(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c != "ts"]
        return df.unpivot(["ts"], [F.col(f"`{c}`").cast("double").alias(c) for c in cols], "approach", name)

    latency = long(wide_latency, "latency").na.fill(0.0, ["latency"])
    parallelism = long(wide_parallelism, "parallelism").where("parallelism IS NOT NULL")
    usage = parallelism.groupBy("approach").agg(
        F.avg("parallelism").alias("mean_parallelism"),
        (F.avg("parallelism") / divisor).alias("resource_usage"),
    )
    return approach_means(latency, "latency").join(usage, "approach")
