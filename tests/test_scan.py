"""Sliced running values equal the ones of one unsliced pass."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadlens.operators.scan import run_starts, running, with_halo


def series(seed: int, rows: int = 400) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    return pd.DataFrame(
        {
            # One key holds most of the rows.
            "k": rng.choice(["hot", "a", "b"], size=rows, p=[0.8, 0.15, 0.05]),
            "t": rng.permutation(rows).astype("int64"),
            "v": rng.integers(0, 9, rows).astype("float64"),
            "c": rng.random(rows) < 0.1,
        }
    )


@pytest.mark.parametrize("seed,width", [(1, 7), (2, 50), (3, 1000)])
def test_running_matches_one_pass(spark, seed, width):
    pdf = series(seed)
    value = F.when(F.col("v") != 3, F.col("v"))
    got = running(
        spark.createDataFrame(pdf),
        ["k"],
        ["t"],
        F.floor(F.col("t") / width),
        {
            "total": ("sum", value),
            "n": ("count", value),
            "high": ("max", value),
            "low": ("min", value),
            "seen": ("last", value),
            "prev": ("lag", value),
            "pos": ("pos", value),
            "hit": ("last_pos", F.col("c")),
            "hit_before": ("prev_pos", F.col("c")),
        },
    ).toPandas()
    got = got.sort_values(["k", "t"]).reset_index(drop=True)
    want = pdf.sort_values(["k", "t"]).reset_index(drop=True)
    want["x"] = want["v"].where(want["v"] != 3)
    by = want.groupby("k")
    pos = by.cumcount() + 1
    expected = {
        "total": by["x"].transform(lambda s: s.fillna(0).cumsum().where(s.notna().cumsum() > 0)),
        "n": by["x"].transform(lambda s: s.notna().cumsum()),
        "high": by["x"].transform(lambda s: s.ffill().expanding().max()),
        "low": by["x"].transform(lambda s: s.ffill().expanding().min()),
        "seen": by["x"].ffill(),
        "prev": by["x"].shift(),
        "pos": pos,
        "hit": pos.where(want["c"]).groupby(want["k"]).ffill(),
    }
    expected["hit_before"] = expected["hit"].groupby(want["k"]).shift()
    for name, column in expected.items():
        np.testing.assert_array_equal(
            got[name].astype(float).to_numpy(), column.astype(float).to_numpy(), err_msg=name
        )


def test_runs_cross_slices(spark):
    values = ["x"] * 10 + ["y"] * 3 + ["x"] * 7 + [None] * 2
    pdf = pd.DataFrame({"k": "a", "t": range(len(values)), "v": values})
    got = run_starts(
        spark.createDataFrame(pdf), ["k"], ["t"], F.floor(F.col("t") / 4), F.col("v")
    )
    sizes = [r["n"] for r in got.groupBy("run").agg(F.count(F.lit(1)).alias("n")).orderBy("run").collect()]
    assert sizes == [10, 3, 7, 2]


def test_halo_completes_frames(spark):
    rows = with_halo(spark.range(100).withColumnRenamed("id", "p"), F.col("p"), 10, 3).collect()
    own = [r for r in rows if r["__own"]]
    assert sorted(r["p"] for r in own) == list(range(100))
    for r in own:
        context = {x["p"] for x in rows if x["__slice"] == r["__slice"]}
        assert {p for p in range(r["p"] - 3, r["p"] + 1) if p >= 0} <= context


def test_halo_wider_than_slice_is_refused(spark):
    with pytest.raises(ValueError):
        with_halo(spark.range(3), F.col("id"), 2, 5)


def test_null_keys_and_null_order_keep_their_carry(spark):
    rows = [(None, i, 1.0) for i in range(6)] + [("a", i, 1.0) for i in range(4)] + [("a", None, 5.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    got = running(
        df, ["k"], ["t"], F.floor(F.col("t") / 2), {"total": ("sum", F.col("v")), "pos": ("pos", F.lit(1))}
    ).collect()
    assert sorted((r["total"], r["pos"]) for r in got if r["k"] is None) == [(float(i), i) for i in range(1, 7)]
    # A null comes first.
    assert [(r["total"], r["pos"]) for r in sorted((r for r in got if r["k"]), key=lambda r: r["pos"])] == [
        (5.0, 1), (6.0, 2), (7.0, 3), (8.0, 4), (9.0, 5),
    ]
