import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from loadlens.llm import queries, whitening


def table(spark, vectors, **extra):
    fields = [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
    fields += [T.StructField(name, T.StringType()) for name in extra]
    rows = [(i, v, *extra.values()) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, T.StructType(fields))


def good(vector):
    return vector is not None and all(c is not None and math.isfinite(c) for c in vector)


def whole(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def brute(vectors):
    """Distinct whole vectors, exact covariance as fractions, and its eigenvalues."""
    fit = sorted({whole(v) for v in vectors if good(v)})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    cov = [
        [sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) for j in range(d)]
        for i in range(d)
    ]
    exact = np.array([[float(Fraction(c, n**3)) for c in row] for row in cov])
    return fit, n, sums, exact, np.linalg.eigvalsh(exact)[::-1]


def check(rows, vectors, components=16):
    fit, n, sums, cov, values = brute(vectors)
    k = min(components, len(sums))
    remaining = {i: whole(v) for i, v in enumerate(vectors) if good(v)}
    assert sorted((r.vec_id, r.component) for r in rows) == [
        (i, c) for i in sorted(remaining) for c in range(1, k + 1)
    ]
    found = np.zeros((len(vectors), k))
    for r in rows:
        found[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.identity_error <= 1e-9
        assert r.deviation == sum((n * x - s) ** 2 for x, s in zip(remaining[r.vec_id], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
    # The coordinates are those of unit eigenvectors: the covariance of the fit list with a
    # coordinate is sqrt(e) times the direction, an eigenvector with eigenvalue e.
    place = {x: i for i, x in remaining.items()}
    own = found[[place[x] for x in fit]]
    centred = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    np.testing.assert_allclose(own.T @ own / n, np.eye(k), atol=1e-9)
    directions = centred.T @ own / n / np.sqrt(values[:k])
    np.testing.assert_allclose(np.linalg.norm(directions, axis=0), 1, atol=1e-9)
    np.testing.assert_allclose(cov @ directions, directions * values[:k], atol=1e-9 * values[0])
    for i, x in remaining.items():  # repeated vectors get the same
        np.testing.assert_array_equal(found[i], found[place[x]])


def random_vectors(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * scale
    return [list(map(float, v)) for v in mixed.astype(np.float32)]


def test_whitening_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    vectors = random_vectors(120, 20, 1)
    vectors += vectors[:30] + [vectors[3]] * 40
    vectors += [None, [None] * 20, [math.nan] + [0.0] * 19, [math.inf] * 20]
    check(whitening.whiten(table(spark, vectors), ["vec_id"]).collect(), vectors)


def test_few_dimensions_and_components(spark):
    vectors = random_vectors(50, 3, 2)
    check(whitening.whiten(table(spark, vectors), ["vec_id"]).collect(), vectors)
    rows = whitening.whiten(table(spark, vectors), ["vec_id"], components=2).collect()
    check(rows, vectors, 2)


def test_large_entries_stay_exact(spark):
    vectors = random_vectors(40, 4, 3, scale=2.0**33)
    rows = whitening.whiten(table(spark, vectors), ["vec_id"]).collect()
    fit, n, sums, cov, values = brute(vectors)
    assert all(r.deviation is None for r in rows)  # beyond a long
    assert {r.component: r.explained for r in rows} == pytest.approx(
        {c + 1: e / np.trace(cov) for c, e in enumerate(values)}, rel=1e-9
    )


def test_extreme_entries(spark):
    vectors = [[3.0e38, 0.0], [-3.0e38, 1.0], [3.0e38, 3.0]]
    rows = whitening.whiten(table(spark, vectors), ["vec_id"]).collect()
    assert {r.n for r in rows} == {3} and all(math.isfinite(r.whitened) for r in rows)


def test_covariance_is_exact(spark):
    whole_numbers = [[1, 5, -7], [2, 5, 9], [2**62, 5, 4], [3, 6, -(2**62)]]
    frame = spark.createDataFrame([(v,) for v in whole_numbers], "x array<bigint>")
    n, sums = 4, tuple(map(sum, zip(*whole_numbers)))
    want = [
        [
            float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in whole_numbers), n**3))
            for j in range(3)
        ]
        for i in range(3)
    ]
    assert whitening.covariance(frame, n, sums).tolist() == want


def test_odd_tables(spark):
    def run(vectors, **extra):
        frame = table(spark, vectors, **extra)
        return whitening.whiten(frame, ["vec_id", *extra])

    assert run([]).count() == run([None, [math.nan]]).count() == run([[], []]).count() == 0
    assert run([[1.0, 2.0]] * 3).count() == 0  # nothing varies
    line = run([[float(i), 5.0, 2.0 * i] for i in range(9)]).collect()
    assert [r.component for r in line] == [1] * 9 and line[0].explained == pytest.approx(1)
    mixed = run([[0.0, 1.0], [1.0, 0.0], [3.0, 1.0], [1.0], [7.0]]).collect()
    assert {r.vec_id for r in mixed} == {0, 1, 2} and mixed[0].n == 3
    ties = run([[0.0], [1.0], [0.0, 1.0], [1.0, 5.0]]).collect()
    assert {r.vec_id for r in ties} == {2, 3}
    clash = run([[0.0, 1.0], [1.0, 0.0], [3.0, 1.0]], n="a", whitened="b", x="c", note="d")
    assert clash.columns == ["vec_id", "note", *whitening.ADDED.names]
    assert {r.note for r in clash.collect()} == {"d"} and clash.count() == 6


def test_query_against_brute_force(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert sorted(vectors) == list(range(len(vectors)))
    rows = queries.QUERIES["op12_embedding_whitening"](spark, sf_dir).collect()
    check(rows, [vectors[i] for i in range(len(vectors))])
