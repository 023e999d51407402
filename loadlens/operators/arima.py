"""ARIMA forecasts for many series, fitted from sums of lagged products.

Both stages of the Hannan-Rissanen estimate (a long autoregression for the innovations, then
a regression on lagged values and lagged innovations) are linear. A block of a series
contributes a small matrix of products, the matrices are added up by Spark, and only their
sum is solved. One series may hold any share of the rows: no task sees more than a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.operators.scan import SLICE, epoch, running, time_slice, with_halo

# Search limits and the 5 % points of the two unit-root tests.
MAX_DIFF, MAX_P, MAX_Q = 6, 5, 5
KPSS_LIMIT, ADF_LIMIT = 0.463, -3.41
LONG_AR = 12
BLOCK_ROWS = 65536
TAIL_ROWS = 128


def _lagged(x: np.ndarray, lags: int) -> np.ndarray:
    """Columns x[t-1] .. x[t-lags] for t = lags .. len(x)-1."""
    return np.column_stack([x[lags - i : len(x) - i] for i in range(1, lags + 1)])


def _block_sums(
    df: DataFrame, keys: Sequence[str], back: int, sums: Callable[[pd.DataFrame], dict[str, np.ndarray]]
) -> DataFrame:
    """Add up, per series, the matrices `sums` derives from every block.

    Blocks repeat `back` earlier rows, marked by `__own` false. Entries travel as rows
    `(name, i, value)`, so the addition is an ordinary aggregate with partial sums.
    """
    keys = list(keys)
    blocks = with_halo(df, F.col("pos"), BLOCK_ROWS, back)
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]
        + ["name string", "i int", "value double"]
    )

    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos").reset_index(drop=True)
        parts = [
            pd.DataFrame({"name": name, "i": np.arange(m.size), "value": m.ravel()})
            for name, m in sums(block).items()
        ]
        if not parts:
            return pd.DataFrame(columns=[*keys, "name", "i", "value"])
        out = pd.concat(parts)
        for key in keys:
            out[key] = block[key].iloc[0]
        return out[[*keys, "name", "i", "value"]]

    return (
        blocks.groupBy(*keys, SLICE)
        .applyInPandas(reduce, schema)
        .groupBy(*keys, "name", "i")
        .agg(F.sum("value").alias("value"))
    )


def _solve(
    summed: DataFrame, keys: Sequence[str], out: str,
    fit: Callable[[dict[str, np.ndarray]], tuple],
) -> DataFrame:
    """Turn the few summed entries of each series into one row of parameters."""
    keys = list(keys)
    key_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in summed.select(*keys).schema]
    names = [c.strip().split(" ")[0] for c in out.split(", ")]

    def one(entries: pd.DataFrame) -> pd.DataFrame:
        mats = {
            name: part.sort_values("i")["value"].to_numpy()
            for name, part in entries.groupby("name")
        }
        row = (*[entries[k].iloc[0] for k in keys], *fit(mats))
        return pd.DataFrame([row], columns=[*keys, *names])

    return summed.groupBy(*keys).applyInPandas(one, ", ".join([*key_types, out]))


def _square(entries: np.ndarray) -> np.ndarray:
    side = int(round(len(entries) ** 0.5))
    return entries.reshape(side, side)


def _least_squares(gram: np.ndarray, columns: Sequence[int]) -> tuple[np.ndarray, float, np.ndarray]:
    """Regression of the last column on `columns`: coefficients, residual sum, inverse."""
    cols = list(columns)
    xx, xy, yy = gram[np.ix_(cols, cols)], gram[cols, -1], gram[-1, -1]
    inverse = np.linalg.pinv(xx, hermitian=True)
    beta = inverse @ xy
    return beta, max(float(yy - beta @ xy), 0.0), inverse


# --- differencing order ----------------------------------------------------------------


def _kpss_lags(size: float) -> int:
    return int(3 * max(size, 0) ** 0.5 / 13)


def _adf_lags(size: float) -> int:
    return int(max(size - 1, 0) ** (1 / 3))


def _test_sums(block: pd.DataFrame) -> dict[str, np.ndarray]:
    """Sums for both unit-root tests; their numbers of lags follow the length of the series."""
    pos, y = block["pos"].to_numpy(), block["y"].to_numpy()
    cum, size = block["cum"].to_numpy(), float(block["n"].iloc[0])
    own = block["__own"].to_numpy()
    kpss, adf = _kpss_lags(size), _adf_lags(size)
    out = {}
    level = y
    for d in range(MAX_DIFF + 1):
        z = np.diff(y, d)
        zpos, zown = pos[d:], own[d:]
        # Partial sums of z up to a constant: the series differenced once less.
        partial = cum if d == 0 else level[1:]
        tau = (zpos - d).astype(float)
        u, s = partial[zown], tau[zown] / size
        out[f"path{d}"] = np.array(
            [zown.sum(), z[zown].sum(), u.sum(), (u * u).sum(), (u * s).sum(), s.sum(), (s * s).sum()]
        )
        start = (pos[d - 1 :] == d) if d else np.zeros(0, bool)
        if d and own[d - 1 :][start].any():
            out[f"start{d}"] = np.array([level[start][0]])
        products = np.zeros(kpss + 1)
        edges = np.zeros((2, kpss + 1))
        for lag in range(min(kpss, len(z)) + 1):
            left, right, mine = z[lag:], z[: len(z) - lag], zown[lag:]
            products[lag] = (left[mine] * right[mine]).sum()
            edges[:, lag] = left[mine].sum(), right[mine].sum()
        out[f"auto{d}"], out[f"edge{d}"] = products, edges
        dz = np.diff(z)
        if len(dz) > adf:
            mine = zown[1 + adf :]
            rows = np.column_stack(
                [
                    np.ones(mine.sum()),
                    (tau[1 + adf :] / size)[mine],
                    z[adf:-1][mine],
                    *([_lagged(dz, adf)[mine]] if adf else []),
                    dz[adf:][mine],
                ]
            )
            out[f"adf{d}"] = rows.T @ rows
        level = z
    return out


def _kpss_stationary(mats: dict[str, np.ndarray], d: int, size: float) -> bool:
    m, total, su, suu, sus, ss, sss = mats[f"path{d}"]
    if m < 3:
        return True
    mean = total / m
    shift = mats[f"start{d}"][0] if f"start{d}" in mats else 0.0
    slope = mean * size
    squares = (
        suu + shift**2 * m + slope**2 * sss - 2 * shift * su - 2 * slope * sus + 2 * shift * slope * ss
    )
    lags = _kpss_lags(m)
    products, edges = mats[f"auto{d}"], mats[f"edge{d}"].reshape(2, -1)
    counts = m - np.arange(len(products))
    centred = products - mean * edges.sum(axis=0) + counts * mean**2
    weights = 1 - np.arange(1, lags + 1) / (lags + 1)
    variance = (centred[0] + 2 * (weights * centred[1 : lags + 1]).sum()) / m
    return variance <= 1e-12 or squares / m**2 / variance < KPSS_LIMIT


def _adf_stationary(mats: dict[str, np.ndarray], d: int) -> bool:
    if f"adf{d}" not in mats:
        return True
    gram = _square(mats[f"adf{d}"])
    m = gram[0, 0]
    columns = range(3 + min(_adf_lags(m), len(gram) - 4))
    if m <= len(columns) + 1:
        return True
    beta, rss, inverse = _least_squares(gram, columns)
    spread = (rss / (m - len(columns)) * inverse[2, 2]) ** 0.5
    return spread <= 1e-12 or beta[2] / spread < ADF_LIMIT


def _pick_difference(mats: dict[str, np.ndarray]) -> tuple[int]:
    size = mats["path0"][0]
    kpss = next((d for d in range(MAX_DIFF) if _kpss_stationary(mats, d, size)), MAX_DIFF)
    adf = next((d for d in range(MAX_DIFF) if _adf_stationary(mats, d)), MAX_DIFF)
    return (max(kpss, adf),)


# --- estimation ------------------------------------------------------------------------


def _difference(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    d = int(block["d"].iloc[0])
    return np.diff(block["y"].to_numpy(), d), block["__own"].to_numpy()[d:]


def _long_sums(block: pd.DataFrame) -> dict[str, np.ndarray]:
    w, own = _difference(block)
    if len(w) <= LONG_AR:
        return {}
    mine = own[LONG_AR:]
    rows = np.column_stack([np.ones(len(mine)), _lagged(w, LONG_AR), w[LONG_AR:]])[mine]
    return {"gram": rows.T @ rows}


def _pick_long(mats: dict[str, np.ndarray]) -> tuple[list[float]]:
    beta, _, _ = _least_squares(_square(mats["gram"]), range(LONG_AR + 1))
    return (beta.tolist(),)


def _innovations(w: np.ndarray, long_ar: np.ndarray) -> np.ndarray:
    """Residuals of the long autoregression, for t = LONG_AR .. len(w)-1."""
    return w[LONG_AR:] - long_ar[0] - _lagged(w, LONG_AR) @ long_ar[1:]


def _short_sums(block: pd.DataFrame) -> dict[str, np.ndarray]:
    w, own = _difference(block)
    if len(w) <= LONG_AR + MAX_Q:
        return {}
    e = _innovations(w, np.asarray(block["long_ar"].iloc[0]))
    later = w[LONG_AR + MAX_Q - MAX_P :]
    mine = own[LONG_AR + MAX_Q :]
    rows = np.column_stack(
        [np.ones(len(mine)), _lagged(later, MAX_P), _lagged(e, MAX_Q), w[LONG_AR + MAX_Q :]]
    )[mine]
    return {"gram": rows.T @ rows}


def lagged_products(
    df: DataFrame, d: int, value: str = "workload", keys: Sequence[str] = ("job",)
) -> DataFrame:
    """Summed products of 1, the LONG_AR values before each and the value itself, of a series
    differenced `d` times: entries `i` of a square matrix, row by row."""
    rows = _series(df, keys, value, None).select(*keys, "pos", "y").withColumn("d", F.lit(d))
    return _block_sums(rows, keys, MAX_DIFF + LONG_AR, _long_sums)


def _damped(coefficients: np.ndarray) -> bool:
    """Whether 1 - c1 z - c2 z^2 ... has all roots outside the unit circle."""
    if not len(coefficients):
        return True
    return bool(np.all(np.abs(np.roots(np.r_[1.0, -coefficients])) < 0.999))


def pick_orders(mats: dict[str, np.ndarray]) -> tuple:
    """Orders p and q with the least information criterion, it, and the coefficients, from the
    products `gram` of 1, MAX_P values, MAX_Q innovations before the value, and the value."""
    gram = _square(mats["gram"])
    m = max(gram[0, 0], 1.0)
    best = None
    for p in range(MAX_P + 1):
        for q in range(MAX_Q + 1):
            columns = [0, *range(1, 1 + p), *range(1 + MAX_P, 1 + MAX_P + q)]
            beta, rss, _ = _least_squares(gram, columns)
            ar, ma = beta[1 : 1 + p], beta[1 + p :]
            if p + q and not (_damped(ar) and _damped(-ma)):
                continue
            aic = m * np.log(max(rss, 1e-9) / m) + 2 * (p + q + 1)
            if best is None or aic < best[2]:
                best = (p, q, float(aic), float(beta[0]), ar.tolist(), ma.tolist())
    return best


def _series(df: DataFrame, keys: Sequence[str], value: str, slice_by: Column | None) -> DataFrame:
    """Rows in order: `pos`, centred value `y`, its running sum `cum`, series length `n`."""
    keys = list(keys)
    slice_by = time_slice(epoch(F.col("ts")), 86400) if slice_by is None else slice_by
    sizes = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("level"), F.max("ts").alias("last_ts")
    )
    centred = df.join(sizes, keys).withColumn("y", F.col(value) - F.col("level"))
    return running(
        centred.select(*keys, "ts", "y", "n", "level", "last_ts"),
        keys,
        ["ts"],
        slice_by,
        {"pos": ("pos", F.col("y")), "cum": ("sum", F.col("y"))},
    )


def _orders(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    longest = rows.agg(F.max("n")).first()[0] or 0
    back = MAX_DIFF + max(_kpss_lags(longest), _adf_lags(longest)) + 1
    return _solve(_block_sums(rows, keys, back, _test_sums), keys, "d int", _pick_difference)


def difference_orders(
    df: DataFrame, value: str = "workload", keys: Sequence[str] = ("job",), slice_by: Column | None = None
) -> DataFrame:
    """`(keys, d)`: the larger differencing order that the two unit-root tests ask for."""
    return _orders(_series(df, keys, value, slice_by), keys)


def fit_arima(
    df: DataFrame, value: str = "workload", keys: Sequence[str] = ("job",), slice_by: Column | None = None
) -> DataFrame:
    """One model per series of `(keys, ts, value)`: `d, p, q, aic, const, ar, ma, long_ar`.

    The differencing order is the larger one asked for by two unit-root tests; p and q
    minimise the information criterion. A series too short for the long autoregression at the
    chosen order is modelled by its mean: all orders 0, no criterion. `ts` must be evenly
    spaced and unique per series.
    """
    keys = list(keys)
    rows = _series(df, keys, value, slice_by)
    orders = _orders(rows, keys)
    plain = rows.select(*keys, "pos", "y").join(orders, keys)
    long = _solve(
        _block_sums(plain, keys, MAX_DIFF + LONG_AR, _long_sums),
        keys,
        "long_ar array<double>",
        _pick_long,
    )
    short = _solve(
        _block_sums(
            plain.join(long, keys), keys, MAX_DIFF + LONG_AR + MAX_Q, _short_sums
        ),
        keys,
        "p int, q int, aic double, const double, ar array<double>, ma array<double>",
        pick_orders,
    )
    made = orders.join(long, keys, "left").join(short, keys, "left")
    fitted = F.col("p").isNotNull()
    nothing = F.array().cast("array<double>")
    return made.select(
        *keys,
        F.when(fitted, F.col("d")).otherwise(0).alias("d"),
        F.when(fitted, F.col("long_ar"))
        .otherwise(F.array_repeat(F.lit(0.0), LONG_AR + 1))
        .alias("long_ar"),
        F.coalesce("p", F.lit(0)).alias("p"),
        F.coalesce("q", F.lit(0)).alias("q"),
        "aic",
        F.coalesce("const", F.lit(0.0)).alias("const"),
        F.coalesce("ar", nothing).alias("ar"),
        F.coalesce("ma", nothing).alias("ma"),
    )


def forecast_arima(
    df: DataFrame,
    models: DataFrame,
    horizon: int = 900,
    value: str = "workload",
    keys: Sequence[str] = ("job",),
    step: int = 1,
    slice_by: Column | None = None,
) -> DataFrame:
    """Continue every series by its model: array `forecast`, first step at `start`.

    `models` may be older than the rows; the newest observations then update the state the
    forecast starts from, without a new fit. Only the last rows of a series are used.
    """
    keys = list(keys)
    rows = _series(df, keys, value, slice_by).filter(F.col("pos") > F.col("n") - TAIL_ROWS)
    tail = rows.select(*keys, "pos", "y", "level", "last_ts").join(models, keys)
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema]

    def ahead(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        first = part.iloc[0]
        y, d = part["y"].to_numpy(), int(first["d"])
        ladder = [np.diff(y, i) for i in range(d + 1)]
        w = ladder[-1]
        e = _innovations(w, np.asarray(first["long_ar"])) if len(w) > LONG_AR else np.zeros(0)
        ar, ma = np.asarray(first["ar"], float), np.asarray(first["ma"], float)
        values = np.r_[np.zeros(MAX_P), w]
        shocks = np.r_[np.zeros(MAX_Q), e]
        steps = np.empty(horizon)
        for h in range(horizon):
            steps[h] = (
                first["const"]
                + ar @ values[::-1][: len(ar)]
                + ma @ shocks[::-1][: len(ma)]
            )
            values, shocks = np.r_[values[1:], steps[h]], np.r_[shocks[1:], 0.0]
        for lower in reversed(ladder[:-1]):
            steps = lower[-1] + np.cumsum(steps)
        out = pd.DataFrame({k: [first[k]] for k in keys})
        out["last_ts"] = first["last_ts"]
        out["forecast"] = [(steps + first["level"]).tolist()]
        return out

    made = tail.groupBy(*keys).applyInPandas(
        ahead, ", ".join([*types, "last_ts timestamp", "forecast array<double>"])
    )
    start = F.col("last_ts") + F.make_dt_interval(secs=F.lit(step))
    return made.select(*keys, start.alias("start"), "forecast")
