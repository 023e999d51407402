import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loadlens.llm import periodic_runs, queries


def brute(words, least=24, repeats=3):
    """Stretches with period p, longest first; only those that no smaller period has."""
    n, found = len(words), []
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, repeats * p):
                own = words[i : i + length]
                if not any(own[q:] == own[:-q] for q in range(1, p)):
                    found.append((i, length, p))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def found_runs(texts, least=24, repeats=3):
    text, *runs = periodic_runs.runs_of([np.array(t, dtype=np.int32) for t in texts], least, repeats)
    out = [[] for _ in texts]
    for k, *run in zip(text.tolist(), *(r.tolist() for r in runs)):
        out[k].append(tuple(run))
    return out


def repetitive(rng):
    words = []
    for _ in range(rng.randrange(1, 6)):
        piece = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(1, 12))]
        words += (piece * rng.randrange(1, 30))[: rng.randrange(1, 90)]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [repetitive(rng) for _ in range(400)]
    texts += [[], [1], [1] * 23, [1] * 24, [1] * 200, [1, 2] * 12, list(range(100)), ([1] * 30 + [2]) * 5]
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts.append(fibonacci[-1])
    assert sum(map(len, map(brute, texts))) > 100
    assert found_runs(texts) == [brute(t) for t in texts]
    assert found_runs(texts, 5, 2) == [brute(t, 5, 2) for t in texts]


def test_bounds_do_not_change_runs(monkeypatch):
    rng = random.Random(6)
    texts = [repetitive(rng) for _ in range(30)]
    monkeypatch.setattr(periodic_runs, "GRID_PLACES", 3)
    monkeypatch.setattr(periodic_runs, "PAIRS", 2)
    assert found_runs(texts) == [brute(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=80))
def test_grammar_tells_how_far_places_agree(words):
    n = len(words)
    grammar = periodic_runs.Grammar(np.array([-1, *words, -2], dtype=np.int32))
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
    a, b = np.array(pairs).T

    def equal(x, y, sign):
        k = 0
        while 0 <= x < n and 0 <= y < n and words[x] == words[y]:
            x, y, k = x + sign, y + sign, k + 1
        return k

    for sign in (1, -1):
        got = grammar.agree(a + 1, b + 1, forward=sign == 1).tolist()
        assert got == [equal(x, y, sign) for x, y in pairs]


def test_equal_symbols_stand_for_equal_words():
    rng = random.Random(8)
    words = np.array([-1, *(w for _ in range(20) for w in repetitive(rng)), -2], dtype=np.int32)
    grammar = periodic_runs.Grammar(words)
    spans = [(i, i + 1) for i in range(len(words))]
    meaning: dict[int, tuple] = {}
    for level, symbols in enumerate(grammar.symbols):
        if level:
            start = grammar.start[level - 1]
            spans = [(spans[x][0], spans[y - 1][1]) for x, y in zip(start, start[1:])]
        for symbol, (x, y) in zip(symbols.tolist(), spans):
            assert meaning.setdefault(symbol, tuple(words[x:y])) == tuple(words[x:y])
    assert len(grammar.symbols[-1]) == 3


def test_a_long_text():
    rng = random.Random(9)
    words = [rng.randrange(500) for _ in range(60_000)]
    words[5_000:25_000] = [words[5_000 + i % 4_000] for i in range(20_000)]
    words[40_000:50_000] = [7] * 10_000
    want = [(5_000, 20_000, 4_000), (40_000, 10_000, 1)]
    got = found_runs([words])[0]
    assert [(p, abs(s - t) < 5, abs(m - n) < 5) for (s, m, p), (t, n, _) in zip(got, want)] == [
        (4_000, True, True),
        (1, True, True),
    ]
    assert len(got) == 2


def test_rows(documents):
    rows = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a b " * 12), (4, "a b " * 12),
        (5, "x " + "A a\xa0b " * 9 + "y\x1cz"), (6, "w" * 100_000), (None, "q " * 24),
    ]
    docs = documents(rows).withColumnRenamed("n_chars", "runs").withColumnRenamed("lang", "collapsed")
    out = periodic_runs.find_runs(docs, ["doc_id", "runs", "collapsed"])
    assert out.columns == ["doc_id", "n_words", "runs", "strongest", "collapsed"]
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed) for r in out.collect()}
    run = (0, 24, 2)
    assert got == {
        1: (0, [], None, ""), 2: (0, [], None, ""), 3: (0, [], None, ""),
        4: (24, [run], run, "a b"),
        5: (20, [], None, "x " + "A a\xa0b " * 9 + "y\x1cz"),
        6: (1, [], None, "w" * 100_000),
        None: (24, [(0, 24, 1)], (0, 24, 1), "q"),
    }
    assert out.count() == len(rows)
    assert periodic_runs.find_runs(documents([]), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, ["doc_id"], repeats=1)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contract_row(doc_id, text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + m for s, m, p in runs)]
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    spelled = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(spelled), digest(" ".join(kept)))


def test_query_against_brute_force(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = queries.QUERIES["op13_periodic_runs"](spark, sf_dir).collect()
    got = {
        r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        for r in rows
    }
    short = [d for d in documents if len(d.text or "") < 12_000]
    assert len(got) == len(documents) and len(short) > 150
    assert {d.doc_id: got[d.doc_id] for d in short} == {d.doc_id: contract_row(d.doc_id, d.text) for d in short}
    assert sum(row[0] for row in got.values()) > 5
