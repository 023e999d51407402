"""Running values over long ordered series.

A plain `Window.partitionBy(job).orderBy(ts)` puts a whole history into one task, which
fails as soon as one job owns a large share of the rows. The helpers here cut each series
into slices (a coarse monotone function of the order column), compute running values
inside a slice, and add a carry taken from one summary row per earlier slice. Results are
the ones of the unsliced window; no task ever sees more than one slice of one series.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"


def time_slice(epoch_seconds: Column, seconds: int) -> Column:
    """Slice number of a point in time; monotone in it."""
    return F.floor(epoch_seconds / F.lit(seconds)).cast("bigint")


def epoch(ts: Column) -> Column:
    """Seconds since 1970 with microsecond fraction kept."""
    return F.unix_micros(ts) / F.lit(1_000_000)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    specs: dict[str, tuple[str, Column]],
) -> DataFrame:
    """Add running values per series, computed slice by slice.

    `order` must be total within a series and `slice_by` monotone in it. `specs` maps a new
    column to `(kind, expression)`; kinds are

    * ``sum`` / ``max`` / ``min`` / ``count``: from the first row to this one,
    * ``last``: latest non-null value up to and including this row,
    * ``lag``: value of the row before this one (null on the first row),
    * ``lead``: value of the row after this one (null on the last row),
    * ``pos``: 1-based position in the series (the expression is ignored),
    * ``last_pos`` / ``prev_pos``: position of the latest row whose condition holds, this
      row included / excluded (null if there is none).
    """
    keys, order = list(keys), list(order)
    part = [*keys, SLICE]
    sliced = df.withColumn(SLICE, slice_by)
    # The rows move once, for the local windows.
    base = sliced.repartition(*part)
    local = Window.partitionBy(*part).orderBy(*order)
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
    position = F.struct(*[F.col(c) for c in order])

    inner, totals, carries, combined = {}, {}, {}, {}
    hits: list[str] = []
    if any(kind in ("pos", "last_pos", "prev_pos") for kind, _ in specs.values()):
        inner["__row"] = F.row_number().over(local)
        totals["__rows_before"] = F.count(F.lit(1))
        carries["__rows_before"] = F.coalesce(F.sum("__rows_before").over(earlier), F.lit(0))
    for name, (kind, expr) in specs.items():
        here, before = f"__in_{name}", f"__up_{name}"
        if kind == "sum":
            inner[here] = F.sum(expr).over(so_far)
            totals[before] = F.sum(expr)
            carries[before] = F.sum(before).over(earlier)
            combined[name] = F.when(
                F.col(here).isNotNull() & F.col(before).isNotNull(), F.col(here) + F.col(before)
            ).otherwise(F.coalesce(here, before))
        elif kind == "count":
            inner[here] = F.count(expr).over(so_far)
            totals[before] = F.count(expr)
            carries[before] = F.sum(before).over(earlier)
            combined[name] = F.col(here) + F.coalesce(before, F.lit(0))
        elif kind in ("max", "min"):
            agg, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
            inner[here] = agg(expr).over(so_far)
            totals[before] = agg(expr)
            carries[before] = agg(before).over(earlier)
            combined[name] = pick(here, before)
        elif kind == "last":
            inner[here] = F.last(expr, ignorenulls=True).over(so_far)
            totals[before] = F.max_by(expr, F.when(expr.isNotNull(), position))
            carries[before] = F.last(before, ignorenulls=True).over(earlier)
            combined[name] = F.coalesce(here, before)
        elif kind == "lag":
            # Boxed, so that a null value differs from "no earlier row".
            boxed = F.struct(expr.alias("v"))
            inner[here] = F.lag(boxed, 1).over(local)
            totals[before] = F.max_by(boxed, position)
            carries[before] = F.last(before, ignorenulls=True).over(earlier)
            combined[name] = F.coalesce(here, before)["v"]
        elif kind == "lead":
            boxed = F.struct(expr.alias("v"))
            inner[here] = F.lead(boxed, 1).over(local)
            totals[before] = F.min_by(boxed, position)
            carries[before] = F.first(before, ignorenulls=True).over(later)
            combined[name] = F.coalesce(here, before)["v"]
        elif kind == "pos":
            combined[name] = F.col("__rows_before") + F.col("__row")
        elif kind in ("last_pos", "prev_pos"):
            # Rows of the slice up to its latest hit; made absolute once the offset is known.
            frame = so_far if kind == "last_pos" else local.rowsBetween(Window.unboundedPreceding, -1)
            hit = F.when(expr, F.col("__row"))
            inner[here] = F.max(hit).over(frame)
            totals[before] = F.max(hit)
            hits.append(before)
            combined[name] = F.coalesce(F.col("__rows_before") + F.col(here), F.col(before))
        else:
            raise ValueError(f"unknown running value: {kind}")

    ranked = base.withColumn("__row", inner.pop("__row")) if "__row" in inner else base
    # Totals that need few columns are combined before they move. Those carrying values read
    # the exchange of the rows, which then serves both.
    if hits:
        source = ranked
    elif all(kind in ("sum", "count", "min", "max", "pos") for kind, _ in specs.values()):
        source = sliced
    else:
        source = base
    per_slice = source.groupBy(*part).agg(*[c.alias(n) for n, c in totals.items()])
    carry = per_slice.select(
        *part, *[c.alias(n) for n, c in carries.items()], *[F.col(h) for h in hits]
    )
    if hits:
        carry = carry.withColumns({h: F.col("__rows_before") + F.col(h) for h in hits}).withColumns(
            {h: F.max(h).over(earlier) for h in hits}
        )
    # Null keys are a series, and rows without a slice (a null order value) one of its slices.
    renamed = carry.withColumnsRenamed({c: f"__at_{c}" for c in part})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__at_{c}")) for c in part])
    return (
        ranked.withColumns(inner)
        .join(renamed, same, "left")
        .withColumns(combined)
        .drop(SLICE, "__row", *inner, *totals, *(f"__at_{c}" for c in part))
    )


def with_halo(
    df: DataFrame, position: Column, width: int, back: int, slice_col: str = SLICE,
    own_col: str = "__own",
) -> DataFrame:
    """Cut an axis into slices of `width` and repeat in each the last `back` units before it.

    A frame reaching at most `back` units backwards is then complete inside its slice; rows
    with `own_col` false only serve as context and are dropped afterwards.
    """
    if back > width:
        raise ValueError("a slice must be at least as wide as the frame")
    home = F.floor(position / F.lit(width)).cast("bigint")
    late = position >= (home + 1) * F.lit(width) - F.lit(back)
    return (
        df.withColumn("__home", home)
        .withColumn(
            slice_col,
            F.explode(
                F.when(late, F.array("__home", F.col("__home") + 1)).otherwise(F.array("__home"))
            ),
        )
        .withColumn(own_col, F.col(slice_col) == F.col("__home"))
        .drop("__home")
    )


def run_starts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    value: Column,
    run_col: str = "run",
) -> DataFrame:
    """Number runs of equal neighbouring values: 1, 2, ... per series.

    Changes are counted inside slices; whether a slice begins a run is decided on the summary
    rows, which hold its first and last value. The rows move once.
    """
    keys, order = list(keys), list(order)
    part = [*keys, SLICE]
    local = Window.partitionBy(*part).orderBy(*order)
    boxed = F.struct(value.alias("x"))
    position = F.struct(*[F.col(c) for c in order])
    base = df.withColumn(SLICE, slice_by).repartition(*part).withColumn("__box", boxed)
    prev = F.lag("__box").over(local)
    changed = F.when(prev.isNotNull() & ~prev["x"].eqNullSafe(F.col("__box.x")), 1).otherwise(0)
    flagged = base.withColumn("__changed", changed)
    slices = flagged.groupBy(*part).agg(
        F.sum("__changed").alias("__inside"),
        F.min_by("__box", position).alias("__first"),
        F.max_by("__box", position).alias("__last"),
    )
    ordered = Window.partitionBy(*keys).orderBy(SLICE)
    before = F.lag("__last").over(ordered)
    begins = F.when(before.isNull() | ~before["x"].eqNullSafe(F.col("__first.x")), 1).otherwise(0)
    counted = slices.withColumn("__begins", begins)
    upto = F.sum(F.col("__begins") + F.col("__inside")).over(
        ordered.rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = counted.select(
        *(F.col(c).alias(f"__at_{c}") for c in part),
        (F.coalesce(upto, F.lit(0)) + F.col("__begins")).alias("__upto"),
    )
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__at_{c}")) for c in part])
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    return (
        flagged.withColumn("__inside", F.sum("__changed").over(so_far))
        .join(carry, same, "left")
        .withColumn(run_col, F.col("__upto") + F.col("__inside"))
        .drop(SLICE, "__box", "__changed", "__inside", "__upto", *(f"__at_{c}" for c in part))
    )
