"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens import session

WORD = r"[^\x20\x09-\x0D]+"
# Units a block of the flight phase holds on average; each leaves two at most.
BLOCK_UNITS = 4096
# Decisions up to which their table is broadcast to the texts; longer ones join by shuffle.
BROADCAST_DECISIONS = 1_000_000


@dataclass(frozen=True)
class Mix:
    """Weights of the sources in code point order (null last), repeating; how often a document
    may be repeated; and the seed of all random choices."""

    weights: tuple[float, ...] = (5, 2, 1)
    cap: int = 3
    seed: int = 7


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray, landing: bool) -> np.ndarray:
    """Move inclusion probabilities until two at most are neither 0 nor 1.

    Three open units at a time move along the null space of their constraints, the number of
    documents and of words, until one of them reaches 0 or 1: both expected totals stay as
    they are. With `landing` the last ones are settled too, first by the number alone, then
    by chance. `draws` are uniform, one for each step; a step settles a unit at least.
    """
    p = p.tolist()
    x = size.tolist()
    result = list(p)
    open_: list[int] = []
    step = 0

    def move(u: list[float]) -> None:
        nonlocal open_, step
        up = down = math.inf
        for i, d in zip(open_, u):
            if d > 0:
                up, down = min(up, (1 - result[i]) / d), min(down, result[i] / d)
            elif d < 0:
                up, down = min(up, result[i] / -d), min(down, (1 - result[i]) / -d)
        by = up if draws[step] * (up + down) < down else -down
        step += 1
        still = []
        for i, d in zip(open_, u):
            value = result[i] + by * d
            if value < 1e-9:
                result[i] = 0.0
            elif value > 1 - 1e-9:
                result[i] = 1.0
            else:
                result[i] = value
                still.append(i)
        open_ = still

    for k, one in enumerate(p):
        if not 0 < one < 1:
            continue
        open_.append(k)
        if len(open_) == 3:
            a, b, c = (x[i] for i in open_)
            u = [c - b, a - c, b - a]
            move(u if any(u) else [1.0, -1.0, 0.0])
    if landing:
        while len(open_) >= 2:
            move([1.0, -1.0, *[0.0] * (len(open_) - 2)])
        if open_:
            result[open_[0]] = float(draws[step] < result[open_[0]])
    return np.array(result)


def _fly(seed: int, level: int):
    """Group function: one flight over a block of units of one source."""

    def run(block: pa.Table) -> pa.Table:
        unit = block["unit"].to_numpy()
        size = block["size"].to_numpy()
        p = block["p"].to_numpy()
        key = block["block"][0].as_py()
        # An order and draws that depend on the units alone, not on where they came from.
        rng = np.random.default_rng([seed, level, key & 0xFFFFFFFF, int(block["salt"][0].as_py()) & 0xFFFFFFFF])
        order = np.lexsort((size, unit))
        order = order[rng.permutation(len(order))]
        draws = rng.random(len(order) + 3)
        flown = flight(p[order], size[order].astype(float), draws, block["blocks"][0].as_py() == 1)
        moved = np.empty(len(order))
        moved[order] = flown
        return block.select(["source_key", "unit", "size", "salt", "blocks", "block"]).append_column(
            "p", pa.array(moved, pa.float64())
        )

    return run


FLOWN = "source_key string, unit long, size long, salt long, blocks long, block long, p double"


def unit_of(doc_id: Column, text: Column) -> Column:
    """What is taken or left together: rows of one doc_id, or of one text without doc_id."""
    return F.xxhash64(doc_id, F.when(doc_id.isNull(), F.coalesce(text, F.lit(""))))


def _source_key(source: Column) -> Column:
    """A source as a string that is never null and tells null from every source."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def ranked(sources: DataFrame) -> DataFrame:
    """Sources with `place`, counted from 0 in code point order with null last.

    Sorted by range, and counted inside partitions: only the partitions' row counts come to
    the driver.
    """
    here = F.spark_partition_id()
    placed = sources.orderBy(F.col("source").asc_nulls_last()).select(
        "*",
        here.alias("part"),
        (F.monotonically_increasing_id() - F.shiftleft(here.cast("long"), 33)).alias("at"),
    )
    placed = session.materialise(placed, "sources")
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    before, offsets = 0, [0] * (max(counts, default=-1) + 1)
    for part in sorted(counts):
        offsets[part], before = before, before + counts[part]
    first = F.element_at(F.array(*map(F.lit, offsets)) if offsets else F.array(F.lit(0)), F.col("part") + 1)
    return placed.select("*", (first + F.col("at")).alias("place")).drop("part", "at")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """source_key, source_size, units and target of every source; written.

    The sum of all sizes is shared by weight; a target stops at `cap` times its source's size
    and what is above is shared among the others, until none is above: all uncapped sources
    then stand at the same level of words per weight.
    """
    sources = sizes.groupBy("source_key", "source").agg(
        F.sum("size").alias("source_size"), F.approx_count_distinct("unit").alias("units")
    )
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    table = ranked(sources).withColumn(
        "weight", F.element_at(weights, (F.col("place") % len(mix.weights) + 1).cast("int"))
    )
    table = session.materialise(table, "source-weights")
    cap = F.col("source_size") * F.lit(float(mix.cap))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.lit(capped >= 0) & (cap <= F.col("weight") * F.lit(level))
        row = table.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count_if(full).alias("capped"),
        ).first()
        if row.capped == capped or not row.weight:
            break
        level, capped = (total - row.held) / row.weight, row.capped
    target = F.least(F.col("weight") * F.lit(level), cap)
    return session.materialise(table.withColumn("target", target), "source-targets")


def decisions(sizes: DataFrame, targets: DataFrame, mix: Mix) -> DataFrame:
    """How often each unit is taken: source_key, unit, times.

    A unit is taken f = target / size of its source times: the whole part of f for certain,
    and once more with the fractional part as its inclusion probability. The flight phase
    runs in blocks of a few thousand units of one source; what a block leaves open meets the
    other blocks' rest on the next level, until a source is down to one block and lands.
    """
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # As many blocks as units need; the count is approximate, its error only moves block sizes.
    units = sizes.groupBy("source_key", "unit").agg(F.sum("size").alias("size"))
    shares = targets.select(
        "source_key",
        F.least(share, F.lit(float(mix.cap))).alias("share"),
        F.greatest(F.lit(1), F.ceil(F.col("units") / BLOCK_UNITS)).cast("long").alias("blocks"),
    )
    rows = session.materialise(units, "units").join(shares, "source_key").select(
        "source_key",
        "unit",
        "size",
        F.xxhash64("source_key").alias("salt"),
        "blocks",
        F.pmod(F.xxhash64("unit", F.lit(mix.seed)), F.col("blocks")).alias("block"),
        (F.col("share") - F.floor("share")).alias("p"),
    )
    whole = shares.select("source_key", F.floor("share").cast("long").alias("whole"))
    done: DataFrame | None = None
    level = 0
    while True:
        flown = rows.groupBy("source_key", "block").applyInArrow(_fly(mix.seed, level), FLOWN)
        flown = session.materialise(flown, "flights")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        settled = flown.where(~open_).select("source_key", "unit", "p")
        done = settled if done is None else done.union(settled)
        rest = flown.where(open_)
        if rest.isEmpty():
            break
        fewer = F.greatest(F.lit(1), F.ceil(F.col("blocks") * 2 / BLOCK_UNITS)).cast("long")
        rows = rest.withColumn("blocks", fewer).withColumn("block", F.pmod("block", "blocks"))
        level += 1
    return done.join(whole, "source_key").select(
        "source_key", "unit", (F.col("whole") + F.col("p").cast("long")).alias("times")
    )


def plan_mix(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    """doc_id, size, source_size, target, times and taken of every row of `documents`.

    Size is the number of words `[^\\x20\\x09-\\x0D]+` of the text; taken is size times how often
    the document is taken, `cap` times at most. Targets: see `source_targets`. The words and
    documents taken from each source differ from its target by what one landing unit weighs.
    Everything follows from the rows and the seed: reruns agree, whatever the partitions.

    Null and empty texts have size 0. Null is a source of its own, the last one. Rows that
    repeat a doc_id within a source, and rows without doc_id that repeat a text, are taken or
    left together. An empty table gives no row; other columns are not read.
    """
    mix = mix or Mix()
    sizes = documents.select(
        "doc_id",
        "source",
        _source_key(F.col("source")).alias("source_key"),
        unit_of(F.col("doc_id"), F.col("text")).alias("unit"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
    )
    sizes = session.materialise(sizes, "document-sizes")
    targets = source_targets(sizes, mix)
    decided = session.materialise(decisions(sizes, targets, mix), "decisions")
    told = targets.select("source_key", "source_size", "target")
    return (
        sizes.join(decided, ["source_key", "unit"])
        .join(told, "source_key")
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            "times",
            (F.col("size") * F.col("times")).alias("taken"),
            "source_key",
            "unit",
        )
    )


def mix_documents(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, numbered in `copy` from 1.

    Edge cases are those of `plan_mix`; a column of the input called copy is replaced.
    """
    plan = plan_mix(documents, mix).where("times > 0").select("source_key", "unit", "times").distinct()
    plan = session.materialise(plan.withColumnsRenamed({"source_key": "s", "unit": "u"}), "mix")
    if plan.count() <= BROADCAST_DECISIONS:
        plan = F.broadcast(plan)
    kept = [c for c in documents.columns if c != "copy"]
    rows = documents.select(
        F.struct(*kept).alias("row"),
        _source_key(F.col("source")).alias("of_source"),
        unit_of(F.col("doc_id"), F.col("text")).alias("of_unit"),
    )
    joined = rows.join(plan, (F.col("of_source") == F.col("s")) & (F.col("of_unit") == F.col("u")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).select(
        "row.*", "copy"
    )
