"""Whitening of embeddings, from exact variances of dimensions and of their pairwise sums.

For two dimensions i and j, Var(i + j) = Var(i) + Var(j) + 2 Cov(i, j). So all covariances
follow from sums of squared centred values, which are added up as whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens import session

# Grid of the whole numbers that stand for the entries.
STEPS, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Rows that are worked on together.
ROWS = 2048

ADDED = T.StructType(
    [
        T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()),
        T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType()),
    ]
)

# Whole numbers beyond a long travel in digits of so many bits.
DIGIT_BITS = 60


@dataclass(frozen=True)
class Whitening:
    """Components of a fit list of n vectors with the per-dimension sums `sums`."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray  # unit eigenvectors as columns, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float

    @property
    def scaled(self) -> np.ndarray:
        return self.directions / np.sqrt(self.eigenvalues)


def whole_entries(vector: Column) -> Column:
    """x = floor(64 c) + 1 000 000 of every entry; null if one is null or not finite, and
    beyond the range of long its nearest end."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    good = F.forall(
        entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))
    )
    end = float(2**63 - 2 * SHIFT)
    whole = F.transform(
        entries,
        lambda c: F.floor(F.greatest(F.least(c * STEPS, F.lit(end)), F.lit(-end))) + SHIFT,
    )
    return F.when(good, whole)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix of longs."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            own = batch.slice(first, ROWS)
            yield own, _matrix(own.column("x"))


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """`x` as longs where sums of `bound` times its square fit them, else as Python's ints."""
    largest = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    return x if bound * (largest + 1) ** 2 < 2**62 else x.astype(object)


def _added(
    vectors: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]
) -> list[int]:
    """Sums over all rows of `width` whole numbers that `part` gives for some rows.

    Each task hands on one row per number, so what is shuffled doesn't grow with the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=object)
        for _, x in _pieces(batches):
            total += part(x)
        rows = [(place, digit, v) for place in range(width) for digit, v in _digits(total[place])]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))],
            names=["place", "digit", "value"],
        )

    digits = vectors.select("x").mapInArrow(run, "place int, digit int, value long")
    sums = digits.groupBy("place", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")))
    found = [0] * width
    for place, digit, value in sums.collect():  # a bounded number, by dimensions
        found[place] += int(value) << (DIGIT_BITS * digit)
    return found


def _digits(number: int) -> Iterator[tuple[int, int]]:
    """A whole number of any size as digits to the base 2**DIGIT_BITS that add up to it."""
    sign, rest, digit = (-1 if number < 0 else 1), abs(int(number)), 0
    while rest:
        if own := rest & ((1 << DIGIT_BITS) - 1):
            yield digit, sign * own
        rest >>= DIGIT_BITS
        digit += 1


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """x - floor(S / n) as whole numbers, and the rest S mod n: n x - S = n z - rest."""
    below = np.array([s // n for s in sums], dtype=object)
    rest = np.array([s % n for s in sums], dtype=object)
    fits = all(abs(b) < 2**62 for b in below) and abs(x).max(initial=0) < 2**62
    z = x - (below.astype(np.int64) if fits else below)
    return z if fits else z.astype(object), rest


def covariance(vectors: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Covariance (divisor n) of the rows of column x, by polarisation.

    One pass adds up the squares of every centred dimension and of every sum of two of them,
    n * (x_i + x_j) - (S_i + S_j), exactly.
    """
    d = len(sums)
    upper = [(i, j) for i in range(d) for j in range(i, d)]

    def part(x: np.ndarray) -> np.ndarray:
        z, rest = _centred(x, n, sums)
        z = _exact(z, 4 * len(z))
        squares, plain = [], z.sum(axis=0).astype(object)
        for i in range(d):
            both = z[:, i:] + z[:, i, None]
            both[:, 0] = z[:, i]
            squares.append((both * both).sum(axis=0).astype(object))
        # (n z - r)^2 added up over the rows, from sums of z^2 and z.
        first = np.concatenate([np.full(d - i, plain[i], dtype=object) for i in range(d)])
        twice = np.concatenate([plain[i:] for i in range(d)])
        r1 = np.concatenate([np.full(d - i, rest[i], dtype=object) for i in range(d)])
        r2 = np.concatenate([rest[i:] for i in range(d)])
        alone = np.array([i == j for i, j in upper])
        total, r = np.where(alone, first, first + twice), np.where(alone, r1, r1 + r2)
        return n * n * np.concatenate(squares) - 2 * n * r * total + len(x) * r * r

    sums_of_squares = dict(zip(upper, _added(vectors, len(upper), part)))
    result = np.empty((d, d))
    for (i, j), both in sums_of_squares.items():
        if i == j:
            result[i, i] = both / n**3
        else:
            cross = both - sums_of_squares[i, i] - sums_of_squares[j, j]
            result[i, j] = result[j, i] = cross / (2 * n**3)
    return result


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors in column x, which all have one length; None if there
    is none."""
    one = vectors.select(F.size("x").alias("d")).first()
    if one is None:
        return None
    d = one["d"]
    n, *sums = _added(
        vectors,
        d + 1,
        lambda x: np.append([len(x)], _exact(x, len(x)).sum(axis=0)).astype(object),
    )
    cov = covariance(vectors, n, tuple(sums)) if d else np.empty((0, 0))
    values, directions = np.linalg.eigh(cov)
    values, directions = values[::-1], directions[:, ::-1]
    # Directions in which nothing varies, as far as double precision tells, have no scale.
    some = values > d * np.finfo(float).eps * values[0] if d else np.empty(0, dtype=bool)
    values, directions = values[some][:components], directions[:, some][:, :components]
    heavy = np.argmax(np.abs(directions), axis=0) if directions.size else np.empty(0, dtype=int)
    directions = directions * np.sign(directions[heavy, np.arange(len(heavy))])
    return Whitening(n, tuple(sums), directions, values, float(np.trace(cov)))


def _project(x: np.ndarray, model: Whitening) -> np.ndarray:
    z, rest = _centred(x, model.n, model.sums)
    return (z.astype(float) - (rest / model.n).astype(float)) @ model.scaled


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity.

    Measured on the rows: a first pass gives the means, a second one the centred products.
    """
    k = len(model.eigenvalues)

    def added(width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for _, x in _pieces(batches):
                total += part(_project(x, model)).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width, dtype=np.int32)), pa.array(total)],
                names=["place", "total"],
            )

        sums = vectors.select("x").mapInArrow(run, "place int, total double")
        rows = dict(map(tuple, sums.groupBy("place").agg(F.sum("total")).collect()))
        return np.array([rows[i] for i in range(width)])

    mean = added(k, lambda w: w.sum(axis=0)) / model.n
    cov = added(k * k, lambda w: (w - mean).T @ (w - mean)).reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def _deviation(x: np.ndarray, model: Whitening) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exactly; null beyond the range of long."""
    z, rest = _centred(x, model.n, model.sums)
    largest = int(abs(z).max(initial=0)) + 1
    if z.shape[1] * (model.n * largest) ** 2 < 2**62:
        off = model.n * z.astype(np.int64) - rest.astype(np.int64)
        return pa.array((off * off).sum(axis=1))
    off = model.n * z.astype(object) - rest
    return pa.array([v if v < 2**63 else None for v in (off * off).sum(axis=1)], pa.int64())


def whiten(
    embeddings: DataFrame, keep: list[str], *, vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Whitened coordinates of every vector, one row per vector and component.

    Entries become whole numbers x = floor(64 c) + 1 000 000. The fit list is each distinct x
    vector once; its n, sums S and covariance (divisor n) are exact up to the last division.
    Adds, for components 1 to `components` by falling eigenvalue e:

    - component, n,
    - deviation: sum over dimensions of (n x - S)^2, exact; null where it exceeds a long,
    - whitened: (x - S / n) along the unit eigenvector, over sqrt(e),
    - explained: e over the trace,
    - identity_error: measured on the fit list, the same in all rows.

    Rows whose vector is null or holds a null or non-finite entry give nothing. Nor do rows of
    another length than the most frequent one (ties: the longer): they are no vectors of that
    space. Repeated rows are returned as often as they stand there. Directions without
    variance have no whitened coordinate and no row, so a table of one distinct vector, or an
    empty one, gives an empty table. There are `components` rows a vector at most, fewer for
    shorter vectors. Returns the columns `keep` and the six, which replace columns of these
    names; a column x is not carried along. The distinct vectors are written to the shared folder once and read three times more.
    """
    spark = embeddings.sparkSession
    keep = [c for c in keep if c not in ADDED.names and c != "x"]
    rows = embeddings.select(*keep, whole_entries(F.col(vector)).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    rows = rows.where(F.size("x") == d)
    # Equal vectors meet after each task has dropped its own repetitions.
    distinct = session.materialise(rows.select("x").distinct(), "vectors")
    fields = {f.name: f for f in embeddings.schema}
    schema = T.StructType([*(fields[c] for c in keep), *ADDED])
    model = fit(distinct, components)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], schema)
    error = identity_error(distinct, model)
    k = len(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = model.eigenvalues / model.trace
        for own, x in _pieces(batches):
            m = len(x)
            row = pa.array(np.repeat(np.arange(m), k))
            kept = [own.column(c).take(row) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    *kept,
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, dtype=np.int64)),
                    _deviation(x, model).take(row),
                    pa.array(_project(x, model).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=[*keep, *ADDED.names],
            )

    return rows.mapInArrow(run, schema)
