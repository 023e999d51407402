"""ARIMA models that every control loop updates, and that bad forecasts replace.

All that an estimate needs is the sum of products of 1, a value and the LAGS values before it:
differences of any order, the long autoregression, its innovations and the final regression
are linear in them. One pass over the rows gives every loop the sum over its whole history, as
a running sum over blocks. From there on a loop is one row, and its own coefficients, under
whatever orders, are a small solve inside that row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadlens import session
from loadlens.operators import forecast
from loadlens.operators.arima import (
    LONG_AR,
    MAX_DIFF,
    MAX_P,
    MAX_Q,
    difference_orders,
    pick_orders,
)
from loadlens.operators.scan import SLICE, epoch, running, time_slice, with_halo

# Values back that the estimates look, and the length of 1, the value and those before it.
LAGS = MAX_DIFF + LONG_AR + MAX_Q
SIDE = LAGS + 2
UPPER = np.triu_indices(SIDE)
# Rows of a block that adds its products up, and loops of history before the first fit.
BLOCK_ROWS = 8192
FIRST_FIT = 8
# Fewer products than this per coefficient of the long autoregression tell too little.
LEAST = 2 * (LONG_AR + 1)
# Largest root of the recursions that a forecast may follow.
DAMPED = 0.999


def _types(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema]


# --- states: one row per loop ------------------------------------------------------------


def _numbered(
    rows: DataFrame, keys: list[str], value: str, slice_by: Column | None
) -> DataFrame:
    """Rows with their position from 1 on, the series' size, and values less its first one."""
    known = rows.where(F.col(value).isNotNull()).select(*keys, "loop", "ts", F.col(value).cast("double").alias("y"))
    sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min_by("y", "ts").alias("base"))
    slice_by = time_slice(epoch(F.col("ts")), 86400) if slice_by is None else slice_by
    placed = running(known, keys, ["ts"], slice_by, {"pos": ("pos", F.col("y"))})
    return placed.join(sizes, keys).withColumn("y", F.col("y") - F.col("base"))


def _block_states(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """For a block: products up to the end of each loop (`loop` set), and in all."""

    columns = [*keys, "block", "base", "loop", "ts", "n", "total", "products", "tail"]

    def run(block: pd.DataFrame) -> pd.DataFrame:
        if not block["__own"].any():  # the series ended with the block before
            return pd.DataFrame(columns=columns)
        block = block.sort_values("pos").reset_index(drop=True)
        y, loop = block["y"].to_numpy(), block["loop"].to_numpy()
        pos, own = block["pos"].to_numpy(), block["__own"].to_numpy()
        first = int(own.argmax())
        # A loop ends before the row that begins another one, or with the series. Its last row
        # may be the one before the block.
        ends = np.flatnonzero(loop[1:] != loop[:-1])
        ends = ends[ends >= first - 1]
        if pos[-1] == block["size"].iloc[0]:
            ends = np.append(ends, len(y) - 1)
        gram, total = np.zeros((SIDE, SIDE)), 0.0
        out = []

        def add(begin: int, end: int) -> None:
            nonlocal total
            total += y[begin:end].sum()
            begin += max(0, LAGS + 1 - int(pos[begin])) if begin < end else 0
            if begin < end:
                lagged = [y[begin - k : end - k] for k in range(LAGS + 1)]
                z = np.column_stack([np.ones(end - begin), *lagged])
                np.add(gram, z.T @ z, out=gram)

        done = first
        for end in ends:
            add(done, end + 1)
            done = max(done, end + 1)
            tail = y[max(0, end - LAGS) : end + 1][::-1]
            out.append((loop[end], block["ts"].iloc[end], pos[end], total, gram[UPPER], tail))
        add(done, len(y))
        out.append((None, None, None, total, gram[UPPER], None))
        made = pd.DataFrame(out, columns=["loop", "ts", "n", "total", "products", "tail"])
        made["loop"], made["n"] = made["loop"].astype("Int64"), made["n"].astype("Int64")
        made["ts"] = pd.to_datetime(made["ts"])
        for key in keys:
            made[key] = block[key].iloc[0]
        made["base"], made["block"] = block["base"].iloc[0], block[SLICE].iloc[0]
        return made[columns]

    return run


def loop_states(
    rows: DataFrame,
    value: str = "workload",
    keys: Sequence[str] = ("job",),
    slice_by: Column | None = None,
) -> DataFrame:
    """One row per series and loop of `(keys, loop, ts, value)`, as known at the loop's end.

    - ts, n: time of the loop's last row, and rows of the series so far,
    - base: the series' first value, which is taken off all others,
    - total: sum of the values so far,
    - products: upper triangle, by rows, of the sum over all rows so far (from row LAGS + 1 on)
      of the products of 1, the value, and the LAGS values before it,
    - tail: the newest LAGS + 1 values, newest first.

    `ts` is unique per series, loops don't decrease with it; rows without value are left out.
    Rows move once, to their blocks of positions; what a block adds up is carried on from block
    to block, so no task sees more than a block.
    """
    keys = list(keys)
    numbered = _numbered(rows, keys, value, slice_by)
    blocks = with_halo(numbered, F.col("pos") - 1, BLOCK_ROWS, LAGS + 1)
    schema = ", ".join(
        [*_types(rows, keys), "block long, base double, loop long, ts timestamp, n long"]
        + ["total double, products array<double>, tail array<double>"]
    )
    made = blocks.groupBy(*keys, SLICE).applyInPandas(_block_states(keys), schema)
    made = session.materialise(made, "loop-states")
    entries = made.where("loop IS NULL").select(
        *keys, "block", F.posexplode(F.concat(F.array("total"), "products")).alias("i", "v")
    )
    earlier = Window.partitionBy(*keys, "i").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = entries.withColumn("v", F.coalesce(F.sum("v").over(earlier), F.lit(0.0)))
    carry = carried.groupBy(*keys, "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("carry")
    )
    ended = made.where("loop IS NOT NULL").join(carry, [*keys, "block"])
    add = F.zip_with("products", F.slice("carry", 2, len(UPPER[0])), lambda a, b: a + b)
    return ended.select(
        *keys,
        "loop",
        "ts",
        "n",
        "base",
        (F.col("total") + F.col("carry")[0]).alias("total"),
        add.alias("products"),
        "tail",
    )


# --- coefficients of a loop --------------------------------------------------------------


def _differenced(d: int) -> np.ndarray:
    """Takes 1, y[t], ..., y[t - LAGS] to 1, w[t], ..., w[t - LONG_AR - MAX_Q], w = y
    differenced d times."""
    size = 1 + LONG_AR + MAX_Q
    out = np.zeros((1 + size, SIDE))
    out[0, 0] = 1
    for back in range(size):
        for k in range(d + 1):
            out[1 + back, 1 + back + k] = (-1) ** k * comb(d, k)
    return out


def _regress(gram: np.ndarray, columns: Sequence[int], target: int) -> np.ndarray:
    """Coefficients of `target` on `columns`, for a stack of product matrices."""
    columns = list(columns)
    inverse = np.linalg.pinv(gram[:, columns][:, :, columns], hermitian=True)
    return np.einsum("bij,bj->bi", inverse, gram[:, columns, target])


def short_products(gram: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Long autoregressions (constant first), and products of 1, MAX_P values, MAX_Q
    innovations before the value, and the value itself; for a stack of sums at order d."""
    take = _differenced(d)
    w = take @ gram @ take.T
    long_ar = _regress(w, [0, *range(2, 2 + LONG_AR)], 1)
    rows = np.zeros((len(gram), 2 + MAX_P + MAX_Q, w.shape[1]))
    rows[:, 0, 0] = 1
    rows[:, -1, 1] = 1
    for k in range(1, MAX_P + 1):
        rows[:, k, 1 + k] = 1
    for k in range(1, MAX_Q + 1):
        at = MAX_P + k
        rows[:, at, 1 + k] = 1
        rows[:, at, 0] = -long_ar[:, 0]
        rows[:, at, 2 + k : 2 + k + LONG_AR] -= long_ar[:, 1:]
    return long_ar, rows @ w @ rows.transpose(0, 2, 1)


def _stable(coefficients: np.ndarray) -> np.ndarray:
    """Coefficients of 1 - c1 z - c2 z^2 ..., shrunk where a root would be beyond DAMPED."""
    if not coefficients.any():
        return coefficients
    largest = np.abs(np.roots(np.r_[1.0, -coefficients])).max()
    if largest <= DAMPED:
        return coefficients
    return coefficients * (DAMPED / largest) ** np.arange(1, len(coefficients) + 1)


def _full(products: pd.Series) -> np.ndarray:
    """Packed upper triangles as a stack of symmetric matrices."""
    packed = np.stack(products.to_numpy())
    out = np.empty((len(packed), SIDE, SIDE))
    out[:, UPPER[0], UPPER[1]] = packed
    out[:, UPPER[1], UPPER[0]] = packed
    return out


def _ahead(states: pd.DataFrame, horizon: int) -> np.ndarray:
    """Forecasts of loops that share d, p and q."""
    d, p, q = (int(states[c].iloc[0]) for c in ("d", "p", "q"))
    size = len(states)
    gram = _full(states["products"])
    long_ar, short = short_products(gram, d)
    beta = _regress(short, [0, *range(1, 1 + p), *range(1 + MAX_P, 1 + MAX_P + q)], -1)
    const, ar, ma = beta[:, 0].copy(), np.zeros((size, MAX_P)), np.zeros((size, MAX_Q))
    values, shocks = np.zeros((size, MAX_P)), np.zeros((size, MAX_Q))
    ladders = np.zeros((size, d + 1))
    mean = (states["total"] / states["n"]).to_numpy()
    for i, tail in enumerate(states["tail"]):
        y = np.asarray(tail, float)[::-1]
        if gram[i, 0, 0] < LEAST:  # a history too short for lags: its mean goes on
            const[i], ladders[i] = 0.0, 0.0
            ladders[i, 0] = mean[i]
            continue
        ar[i, :p] = _stable(beta[i, 1 : 1 + p])
        ma[i, :q] = -_stable(-beta[i, 1 + p :])
        steps = [np.diff(y, k) for k in range(d + 1)]
        ladders[i] = [line[-1] for line in steps]
        w = steps[-1][::-1]  # newest first
        values[i] = w[:MAX_P]
        for k in range(MAX_Q):
            shocks[i, k] = w[k] - long_ar[i, 0] - long_ar[i, 1:] @ w[k + 1 : k + 1 + LONG_AR]
    short_ones = gram[:, 0, 0] < LEAST
    made = np.empty((size, horizon))
    for h in range(horizon):
        made[:, h] = const + (ar * values).sum(axis=1) + (ma * shocks).sum(axis=1)
        values = np.column_stack([made[:, h], values[:, :-1]])
        shocks = np.column_stack([np.zeros(size), shocks[:, :-1]])
    for k in range(d - 1, -1, -1):
        made = ladders[:, k, None] + np.cumsum(made, axis=1)
    made[short_ones] = ladders[short_ones, 0, None]
    return made + states["base"].to_numpy()[:, None]


def forecast_states(
    states: DataFrame, horizon: int = 900, keys: Sequence[str] = ("job",), step: int = 1
) -> DataFrame:
    """`(keys, loop, start, forecast)` of loop states that carry the orders d, p, q.

    Every loop has coefficients of its own, estimated from all rows up to its end.
    """
    keys = list(keys)

    def run(parts):
        for part in parts:
            out = part[[*keys, "loop", "ts"]].copy()
            made = pd.Series(index=part.index, dtype=object)
            for _, same in part.groupby(["d", "p", "q"]):
                for at, line in zip(same.index, _ahead(same, horizon)):
                    made.at[at] = line.tolist()
            out["forecast"] = made
            yield out

    schema = ", ".join([*_types(states, keys), "loop long, ts timestamp, forecast array<double>"])
    needed = ["loop", "ts", "n", "base", "total", "products", "tail", "d", "p", "q"]
    made = states.select(*keys, *needed).mapInPandas(run, schema)
    start = F.col("ts") + F.make_dt_interval(secs=F.lit(step))
    return made.select(*keys, "loop", start.alias("start"), "forecast")


# --- versions: orders chosen at events ---------------------------------------------------


def fit_versions(
    rows: DataFrame,
    states: DataFrame,
    events: DataFrame,
    value: str = "workload",
    keys: Sequence[str] = ("job",),
    slice_by: Column | None = None,
) -> DataFrame:
    """Orders `(keys, since, cutoff, d, p, q)` for events `(keys, since, cutoff)`.

    One event per series: d is asked for by the unit-root tests over all rows up to the end of
    loop `cutoff`, p and q minimise the information criterion of that loop's state.
    """
    keys = list(keys)
    training = rows.where(F.col(value).isNotNull()).join(events, keys).where("loop <= cutoff")
    orders = difference_orders(training.select(*keys, "ts", value), value, keys, slice_by)
    at = states.join(events, keys).where("loop = cutoff").join(orders, keys, "left")
    at = at.select(*keys, "since", "cutoff", F.coalesce("d", F.lit(0)).alias("d"), "products")

    def pick(parts):
        for part in parts:
            out = part[[*keys, "since", "cutoff", "d"]].copy()
            chosen = []
            for d, gram in zip(part["d"], _full(part["products"]) if len(part) else ()):
                if gram[0, 0] < LEAST:
                    chosen.append((0, 0, 0))
                    continue
                _, short = short_products(gram[None], int(d))
                chosen.append((d, *pick_orders({"gram": short[0].ravel()})[:2]))
            out[["d", "p", "q"]] = np.array(chosen, dtype=int).reshape(-1, 3)
            yield out

    schema = ", ".join([*_types(states, keys), "since long, cutoff long, d int, p int, q int"])
    return at.mapInPandas(pick, schema)


def first_events(states: DataFrame, keys: Sequence[str] = ("job",), first: int = FIRST_FIT) -> DataFrame:
    """The loop `first` loops after a series' begin: fitted at its end, in use from there."""
    keys = list(keys)
    begin = states.groupBy(*keys).agg(F.min("loop").alias("begin"))
    old = states.select(*keys, "loop").join(begin, keys).where(F.col("loop") >= F.col("begin") + first)
    return old.groupBy(*keys).agg(F.min("loop").alias("since"), F.min("loop").alias("cutoff"))


def newest_version(
    loops: DataFrame, versions: DataFrame, keys: Sequence[str] = ("job",)
) -> DataFrame:
    """`(keys, loop)` with `version`, the newest one in use at the loop; others are left out.

    An as-of join by one running value over loops and versions together.
    """
    keys = list(keys)
    columns = [c for c in versions.columns if c not in keys]
    marked = versions.select(
        *keys, F.col("since").alias("loop"), F.lit(0).alias("kind"), F.struct(*columns).alias("made")
    )
    asked = loops.select(*keys, "loop", F.lit(1).alias("kind"))
    both = marked.unionByName(asked, allowMissingColumns=True)
    slices = F.floor(F.col("loop") / forecast.LOOPS_PER_SLICE)
    known = running(both, keys, ["loop", "kind"], slices, {"version": ("last", F.col("made"))})
    return known.where("kind = 1 AND version IS NOT NULL").select(*keys, "loop", "version")


def versions_by_events(
    first: DataFrame,
    fit: Callable[[DataFrame], DataFrame],
    score: Callable[[DataFrame], DataFrame],
    after: int = forecast.RETRAIN_AFTER,
) -> DataFrame:
    """All model versions of all jobs: the first ones, and one after each streak.

    `fit` turns events `(job, since, cutoff)`, one per job, into versions with these columns.
    `score` gives the accuracy `(job, loop, overlap, wape)` of the forecasts that those
    versions, if kept, make from loop `since` on. Where `after` forecasts of a version in a
    row are bad, a new one is fitted on the history up to that loop; it forecasts from the
    next loop on, and the streak is counted anew. Rounds go on until no job has a new streak;
    each round works on the jobs that had one, from there on.
    """
    made = []
    events = first
    while True:
        versions = session.materialise(fit(events), "versions")
        made.append(versions)
        judged = score(versions).join(versions.select("job", "since"), "job").where("loop > since")
        streaks = forecast.bad_streaks(judged.drop("since"), after)
        events = (
            streaks.where("needs_retrain").groupBy("job").agg(F.min("loop").alias("cutoff"))
        ).select("job", (F.col("cutoff") + 1).alias("since"), "cutoff")
        events = session.materialise(events, "refits")
        if events.isEmpty():
            break
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def fleet_versions(
    rows: DataFrame,
    states: DataFrame,
    horizon: int = 900,
    step: int = 1,
    slice_by: Column | None = None,
    first: int = FIRST_FIT,
    after: int = forecast.RETRAIN_AFTER,
) -> DataFrame:
    """ARIMA versions `(job, since, cutoff, d, p, q)` of every job's workload."""

    def fit(events: DataFrame) -> DataFrame:
        return fit_versions(rows, states, events, slice_by=slice_by)

    def score(versions: DataFrame) -> DataFrame:
        own = states.join(versions, "job").where("loop >= since")
        later = rows.join(versions.select("job", "since"), "job").where("loop >= since")
        return forecast.wape(later.drop("since"), forecast_states(own, horizon, step=step), step)

    return versions_by_events(first_events(states, first=first), fit, score, after)


def forecast_loops(
    states: DataFrame, versions: DataFrame, horizon: int = 900, step: int = 1
) -> DataFrame:
    """`(job, loop, start, forecast)` of every loop that has a version, by the newest one."""
    known = newest_version(states, versions).select("job", "loop", "version.d", "version.p", "version.q")
    return forecast_states(states.join(known, ["job", "loop"]), horizon, step=step)
