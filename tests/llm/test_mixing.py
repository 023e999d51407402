import random
import re
from collections import defaultdict

import numpy as np
import pytest

from loadlens.llm import mixing
from loadlens.llm.mixing import Mix, flight, mix_documents, plan_mix


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(rows, mix):
    """Targets by filling up, one overflow after the other."""
    sizes = defaultdict(int)
    for _, text, _, source, _ in rows:
        sizes[source] += size_of(text)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > mix.cap * sizes[s]}
        for s in over or open_:
            target[s] = mix.cap * sizes[s] if over else weight[s] * level
            left -= target[s]
        open_ -= over or open_
    return sizes, target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    made = []
    for i in range(1500):
        source = rng.choice(["a", "a", "a", "b", "c", "é", "Z", None, "tiny" if i < 30 else "a"])
        text = " ".join("w" for _ in range(int(rng.paretovariate(1.2) * 10) % 4000))
        made.append((i, rng.choice([text, text, text, f"\n{text}\t"]), "en", source, 0))
    return made + [(2000, None, "en", "b", 0), (2001, "", None, "c", None), (None, "x y", "en", "a", 0), (None, "x y", "en", "a", 0)]


def test_targets_and_totals(documents, rows, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_UNITS", 64)  # several levels
    mix = Mix()
    plan = plan_mix(documents(rows)).collect()
    assert len(plan) == len(rows)
    sizes, want = targets(rows, mix)
    source = {r[0]: r[3] for r in rows}
    text = {r[0]: r[1] for r in rows}
    taken, count, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for row in plan:
        own = source[row.doc_id]
        assert row.size == size_of(text[row.doc_id]) and row.source_size == sizes[own]
        assert row.target == pytest.approx(want[own])
        share = want[own] / sizes[own]
        assert int(share + 1e-9) <= row.times <= min(int(share) + 1, mix.cap)
        assert row.taken == row.size * row.times <= mix.cap * row.size
        taken[own] += row.taken
        count[own] += row.times
        largest[own] = max(largest[own], row.size)
    for own in sizes:
        # Two open units at most land: words by the largest document, documents by one or two.
        assert abs(taken[own] - want[own]) <= 2 * largest[own] + 1e-6
        members = sum(1 for r in rows if r[3] == own)
        assert abs(count[own] - members * want[own] / sizes[own]) <= 3


def test_reruns_and_partitions_agree(documents, rows):
    first = sorted((r.doc_id or -1, r.times) for r in plan_mix(documents(rows)).collect())
    again = sorted((r.doc_id or -1, r.times) for r in plan_mix(documents(rows[::-1]).repartition(7)).collect())
    assert first == again


def test_mix_repeats_rows(documents, rows):
    docs = documents(rows[:300]).withColumnRenamed("lang", "copy")
    times = {r.doc_id: r.times for r in plan_mix(docs).collect()}
    got = defaultdict(list)
    mixed = mix_documents(docs)
    for r in mixed.collect():
        got[r.doc_id].append(r.copy if not callable(r.copy) else r["copy"])
    assert {i: sorted(c) for i, c in got.items()} == {i: list(range(1, n + 1)) for i, n in times.items() if n}
    assert sorted(mixed.columns) == sorted(docs.columns)


def test_empty_and_wordless(documents):
    assert plan_mix(documents([])).count() == 0 and mix_documents(documents([])).count() == 0
    (row,) = plan_mix(documents([None])).collect()
    assert (row.size, row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 1000, 500).astype(float)
    p = np.full(500, 0.3)
    flown = flight(p, size, rng.random(503), False)
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(150) and (flown * size).sum() == pytest.approx((p * size).sum())
    landed = flight(p, size, rng.random(503), True)
    assert set(landed.tolist()) <= {0.0, 1.0}
    means = np.mean([flight(p[:20], size[:20], rng.random(23), True) for _ in range(4000)], axis=0)
    assert np.abs(means - 0.3).max() < 0.05
