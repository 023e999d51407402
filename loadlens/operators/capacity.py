"""Worker and job capacity, corrected for load skew, per control loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loadlens import session
from loadlens.operators import regression
from loadlens.operators.scan import running
from loadlens.operators.telemetry import drop_warm_up, is_number

MAX_SCALEOUT = 18
# Larger than any capacity; thresholds at or above it are never reached.
NEVER = 1 << 50
# Rows per block of a fold. At least 51, so that halving once per row leaves a block only two
# possible ends for any positive start below NEVER.
FOLD_ROWS = 64


def whole(value: Column) -> Column:
    """Truncation towards zero."""
    return value.cast("bigint")


def loop_frames(samples: DataFrame, uptime: DataFrame | None = None, minimum_ms: int = 120000) -> DataFrame:
    """Align `(job, pod, loop, ts, cpu, throughput)` rows the way a loop sees them.

    Within a loop only timestamps and pods known to both metrics stay, and warm-up
    timestamps go. A cell may still lack one of the two values. The frame is partitioned by
    `(job, loop)` once; everything per loop downstream reuses that partitioning.
    """
    rows = samples.repartition("job", "loop")
    if uptime is not None:
        rows = drop_warm_up(rows, uptime, minimum_ms)
    per_ts, per_pod = Window.partitionBy("job", "loop", "ts"), Window.partitionBy("job", "loop", "pod")

    def known(column: str, window) -> Column:
        return F.max(is_number(column).cast("int")).over(window) == 1

    flags = {
        "__t": known("cpu", per_ts) & known("throughput", per_ts),
        "__p": known("cpu", per_pod) & known("throughput", per_pod),
    }
    return rows.withColumns(flags).filter(F.col("__t") & F.col("__p")).drop("__t", "__p")


def loop_pods(frames: DataFrame) -> DataFrame:
    """Per pod and loop: means for the skew factor and moments of the complete samples.

    `usable` is false for all pods of a loop in which some pod has no complete sample; such
    a loop updates nothing.
    """
    whole_row = is_number("cpu") & is_number("throughput")
    x, y = F.when(whole_row, F.col("cpu")), F.when(whole_row, F.col("throughput"))
    seen = frames.groupBy("job", "loop", "pod").agg(
        F.avg(F.when(is_number("cpu"), F.col("cpu"))).alias("cpu_mean"),
        F.count(x).alias("k"),
        F.avg(x).alias("mx"),
        F.avg(y).alias("my"),
        (F.var_pop(x) * F.count(x)).alias("sxx"),
        (F.covar_pop(x, y) * F.count(x)).alias("sxy"),
        F.sum(x).alias("cpu_sum"),
        F.sum(y).alias("throughput_sum"),
    )
    loop = Window.partitionBy("job", "loop")
    return seen.withColumns(
        {
            "max_cpu_mean": F.max("cpu_mean").over(loop),
            "usable": F.min("k").over(loop) > 0,
        }
    ).withColumn("k", F.when(F.col("usable"), F.col("k")).otherwise(0))


def pod_capacity(pods: DataFrame) -> DataFrame:
    """Capacity of every pod after each usable loop: its line at the skew-corrected load."""
    lines = regression.fold_lines(regression.with_sessions(pods)).filter("usable")
    skew = 1 - (F.col("max_cpu_mean") - F.col("mx"))
    return lines.select(
        "job",
        "pod",
        "loop",
        skew.alias("skew"),
        "slope",
        "intercept",
        whole(F.col("slope") * skew + F.col("intercept")).alias("capacity"),
    )


def job_capacity(pod_rows: DataFrame) -> DataFrame:
    """Sum of the pods' whole capacities."""
    return pod_rows.groupBy("job", "loop").agg(F.sum("capacity").alias("capacity"))


# --- decaying averages -----------------------------------------------------------------


def _halved(old: Column, new: Column) -> Column:
    """Half the sum of positive whole numbers, cut to a whole number."""
    return F.shiftright(old + new, 1)


def _fold_in_order(
    rows: DataFrame, keys: Sequence[str], order: str, out: str, fold: Callable, start: object
) -> DataFrame:
    """Add `out = state after the row`, with `state = fold(state, row)` along `order`.

    Rows are sorted by Spark and pass a worker one by one; it holds one state, whatever the
    length of a series. For series that are short by nature: one row per block or loop.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, start
        for batch in batches:
            values = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != at:
                    at, state = key, start
                state = fold(state, row)
                values.append(state)
            kind = pa.float64() if fold is _start_of_linear_block else pa.int64()
            yield batch.append_column(out, pa.array(values, kind))

    kind = DoubleType() if fold is _start_of_linear_block else LongType()
    schema = StructType([*rows.schema.fields, StructField(out, kind)])
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, order)
    return placed.mapInArrow(run, schema)


def _start_of_linear_block(state, row):
    """End of the block: linear in its start; a series starts from its own first value."""
    return row["a"] + row["b"] * (row["first"] if state is None else state)


def _start_of_whole_block(state, row):
    """End of the block: one of two values, told apart by the start."""
    return row["a"] + (1 if (row["first"] if state is None else state) >= row["b"] else 0)


def _reset_or_halve(state, row):
    """A state of 0 knows nothing and takes the value; else half the sum, cut towards zero."""
    value = row["__v"]
    if not state:
        return value
    total = state + value
    return total // 2 if total >= 0 else -(-total // 2)


def decaying_average(
    rows: DataFrame, keys: Sequence[str], value: str, out: str, truncate: bool
) -> DataFrame:
    """First value as is, then `(old + new) / 2` per row in `loop` order; null values are
    skipped.

    With `truncate` each step is cut to a whole number towards zero, and an average of 0
    counts as unknown: the next value replaces it. While values are positive that fold maps,
    over a block of rows, a state x to `low + (x >= threshold)`; without truncation it is
    linear in x. So blocks of fixed length are summarised in parallel, one summary row per
    block is chained, and every block is replayed from its own start state. Series that hold
    a value of 0 or less are folded row by row instead.
    """
    keys = list(keys)
    known = rows.select(*keys, "loop", F.col(value).alias("__v")).where("__v IS NOT NULL")
    if not truncate:
        return _decayed_by_block(known, keys, out, truncate)
    known = session.materialise(known, "decaying")
    odd = known.where("__v <= 0").select(*keys).distinct()
    odd = session.materialise(odd, "decaying-odd")
    if odd.isEmpty():
        return _decayed_by_block(known, keys, out, truncate)
    slow = _fold_in_order(
        _with_keys(known, odd, keys, "left_semi"), keys, "loop", out, _reset_or_halve, 0
    ).drop("__v")
    fast = _decayed_by_block(_with_keys(known, odd, keys, "left_anti"), keys, out, truncate)
    return fast.unionByName(slow)


def _with_keys(rows: DataFrame, some: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Rows whose keys are, or aren't, among `some`; null keys compare equal."""
    other = some.toDF(*(f"__k{i}" for i in range(len(keys))))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(other, reduce(and_, same), how)


def _decayed_by_block(known: DataFrame, keys: list[str], out: str, truncate: bool) -> DataFrame:
    numbered = running(
        known,
        keys,
        ["loop"],
        F.floor(F.col("loop") / regression.LOOPS_PER_SLICE),
        {"__pos": ("pos", F.lit(1))},
    )
    blocks = (
        numbered.withColumn("__block", F.floor((F.col("__pos") - 1) / FOLD_ROWS))
        .groupBy(*keys, "__block")
        .agg(F.sort_array(F.collect_list(F.struct("loop", F.col("__v").alias("v")))).alias("__rows"))
    )
    values = F.transform("__rows", lambda r: r["v"])
    kind = "bigint" if truncate else "double"
    if truncate:
        a = F.aggregate(values, F.lit(0).cast(kind), _halved)
        b = F.aggregate(
            F.reverse(values),
            a + 1,
            lambda t, v: F.least(t * 2 - v, F.lit(NEVER).cast("bigint")),
        )
        step, fold = _halved, _start_of_whole_block
    else:
        a = F.aggregate(values, F.lit(0.0), lambda x, v: (x + v) / 2)
        b = F.pow(F.lit(0.5), F.size(values))
        fold = _start_of_linear_block

        def step(x: Column, v: Column) -> Column:
            return (x + v) / 2

    # (x + x) / 2 = x: starting a series from its own first value reproduces "first as is".
    blocks = blocks.withColumn("__first", F.transform("__rows", lambda r: r["v"])[0].cast(kind))
    summaries = blocks.select(
        *keys, "__block", a.cast(kind).alias("a"), b.cast(kind).alias("b"), F.col("__first").alias("first")
    )
    ends = _fold_in_order(summaries, keys, "__block", "__end", fold, None)
    ends = ends.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), (F.col("__block") + 1).alias("__next"), "__end")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    started = blocks.join(ends, reduce(and_, same) & (F.col("__block") == F.col("__next")), "left")
    replay = F.aggregate(
        values,
        F.struct(
            F.coalesce("__end", "__first").alias("x"), F.array().cast(f"array<{kind}>").alias("xs")
        ),
        lambda acc, v: F.struct(
            step(acc["x"], v).cast(kind).alias("x"),
            F.concat(acc["xs"], F.array(step(acc["x"], v).cast(kind))).alias("xs"),
        ),
    )["xs"]
    return (
        started.withColumn(
            "__all", F.arrays_zip(F.transform("__rows", lambda r: r["loop"]).alias("loop"), replay.alias("x"))
        )
        .select(*keys, F.explode("__all").alias("r"))
        .select(*keys, F.col("r.loop").alias("loop"), F.col("r.x").alias(out))
    )


def simple_capacity(pods: DataFrame) -> DataFrame:
    """Alternative without a line: cpu-weighted throughput per cpu, halved into the past.

    A pod that is away for a loop loses its average, as it loses its line.
    """
    per_loop = regression.with_sessions(pods).filter(F.col("usable") & (F.col("cpu_sum") > 0))
    weighted = whole(F.col("throughput_sum") / F.col("cpu_sum")).cast("double")
    keys = ["job", "pod", "session"]
    return decaying_average(
        per_loop.withColumn("weighted", weighted), keys, "weighted", "simple_capacity", truncate=False
    ).drop("session")


def observed_capacity(job_rows: DataFrame) -> DataFrame:
    """Decaying whole average per `(job, parallelism)` of rows `(job, loop, parallelism,
    capacity)`. Every known capacity counts, 0 and negative ones too; an average of 0 is
    replaced by the next value."""
    return decaying_average(job_rows, ["job", "parallelism"], "capacity", "observed", truncate=True)


# --- capacity per scale-out ------------------------------------------------------------


def estimated_capacity(scaleout: Column, capacity: Column, parallelism: Column) -> Column:
    """Whole linear share of a known capacity; 0 for scale-out 0."""
    return whole(scaleout * F.try_divide(capacity.cast("double"), parallelism.cast("double")))


def capacity_table(job_rows: DataFrame, max_scaleout: int = MAX_SCALEOUT) -> DataFrame:
    """Capacity of every scale-out 0..max as known after each loop.

    Takes `(job, loop, parallelism, capacity)`, capacity null where the loop updated nothing.
    Adds the array `capacities`: the value last observed at that scale-out if there is one and
    it isn't 0, else the estimate from the latest known capacity, else 0.
    """
    observed = observed_capacity(job_rows)
    joined = job_rows.join(observed, ["job", "parallelism", "loop"], "left")
    scaleouts = range(max_scaleout + 1)
    known = F.when(F.col("capacity").isNotNull(), F.struct("capacity", "parallelism"))
    specs = {"__known": ("last", known)}
    for p in scaleouts:
        specs[f"__o{p}"] = ("last", F.when(F.col("parallelism") == p, F.col("observed")))
    tracked = running(
        joined, ["job"], ["loop"], F.floor(F.col("loop") / regression.LOOPS_PER_SLICE), specs
    )
    table = F.array(
        *[
            F.coalesce(
                F.nullif(F.col(f"__o{p}"), F.lit(0)),
                estimated_capacity(F.lit(p), F.col("__known.capacity"), F.col("__known.parallelism")),
                F.lit(0),
            )
            for p in scaleouts
        ]
    )
    return tracked.withColumn("capacities", table).drop(*specs)


def capacity_rows(table: DataFrame) -> DataFrame:
    """One row per candidate scale-out."""
    return table.select(
        "job", "loop", "parallelism", F.posexplode("capacities").alias("scaleout", "capacity")
    )
