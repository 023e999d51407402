"""Models kept as streaming state: residual moments and per-pod load lines.

Both take one reduced row per key and loop, so state and input stay small; they give the
numbers of their batch forms in `operators.anomaly` and `operators.regression`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LINE_STATE = "last_loop bigint, n bigint, mx double, my double, v double, c double"
LINE_OUT = (
    "job string, pod string, loop bigint, n bigint, mean_x double, mean_y double, "
    "slope double, intercept double"
)
MOMENT_STATE = "n bigint, mean double, m2 double"
MOMENT_OUT = "job string, loop bigint, n bigint, mean double, std double"


def loop_moments_stream(samples: DataFrame, loop: str = "60 seconds", delay: str = "2 seconds") -> DataFrame:
    """Closed loops of `(job, pod, ts, cpu, throughput)` reduced to their moments."""
    return (
        samples.withWatermark("ts", delay)
        .groupBy("job", "pod", F.window("ts", loop).alias("w"))
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.avg("cpu").alias("mx"),
            F.avg("throughput").alias("my"),
            (F.var_pop("cpu") * F.count(F.lit(1))).alias("sxx"),
            (F.covar_pop("cpu", "throughput") * F.count(F.lit(1))).alias("sxy"),
        )
        .select("job", "pod", "w", "k", "mx", "my", "sxx", "sxy")
    )


class LineProcessor(StatefulProcessor):
    """Folds loop moments into a pod's line; a skipped loop starts it afresh.

    A loop without samples (k = 0) keeps the line but counts as present. Loops must come in
    order: one that is not newer than the last is late and leaves no trace.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("line", LINE_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n, mx, my, v, c = self.state.get() if self.state.exists() else (None, 0, 0.0, 0.0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(rows)).sort_values("loop").itertuples():
            if last is not None and r.loop <= last:
                continue
            if last is None or r.loop - last > 1:
                n, mx, my, v, c = 0, 0.0, 0.0, 0.0, 0.0
            last = int(r.loop)
            if not r.k:
                out.append((*key, last, n, *self.line(n, mx, my, v, c)))
                continue
            k = int(r.k)
            n += k
            shrink = (n - 1) / n
            # Centred sums moved from the loop's own means to the means before it.
            sxx = r.sxx + k * (r.mx - mx) ** 2
            sxy = r.sxy + k * (r.mx - mx) * (r.my - my)
            v += (shrink * sxx - k * v) / n
            c += (shrink * sxy - k * c) / n
            mx += k * (r.mx - mx) / n
            my += k * (r.my - my) / n
            out.append((*key, last, n, *self.line(n, mx, my, v, c)))
        self.state.update((last, n, mx, my, v, c))
        names = ["job", "pod", "loop", "n", "mean_x", "mean_y", "slope", "intercept"]
        yield pd.DataFrame(out, columns=names)

    @staticmethod
    def line(n: int, mx: float, my: float, v: float, c: float) -> tuple:
        """Means, slope and intercept; null where nothing is known yet."""
        if not n:
            return None, None, None, None
        slope = c / v if v else None
        return mx, my, slope, None if slope is None else my - slope * mx

    def close(self) -> None:
        pass


class MomentProcessor(StatefulProcessor):
    """Folds per-loop residual moments into a job's running count, mean and deviation.

    A loop without residuals (k = 0) changes nothing and gives no row. The moments are sums,
    so a loop that comes late still counts, from its arrival on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", MOMENT_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2 = self.state.get() if self.state.exists() else (0, 0.0, 0.0)
        out = []
        for r in pd.concat(list(rows)).sort_values("loop").itertuples():
            if not r.k:
                continue
            k = int(r.k)
            total = n + k
            shift = r.mr - mean
            m2 += r.srr + shift**2 * n * k / total
            mean += shift * k / total
            n = total
            out.append((*key, int(r.loop), n, mean, (m2 / n) ** 0.5))
        self.state.update((n, mean, m2))
        yield pd.DataFrame(out, columns=["job", "loop", "n", "mean", "std"])

    def close(self) -> None:
        pass


def online_lines(moments: DataFrame) -> DataFrame:
    """`(job, pod, loop, k, mx, my, sxx, sxy)` -> line after each loop."""
    return moments.groupBy("job", "pod").transformWithStateInPandas(
        LineProcessor(), LINE_OUT, "Append", "None"
    )


def online_residual_moments(moments: DataFrame) -> DataFrame:
    """`(job, loop, k, mr, srr)` -> moments after each loop; `srr` is the centred sum."""
    return moments.groupBy("job").transformWithStateInPandas(
        MomentProcessor(), MOMENT_OUT, "Append", "None"
    )
