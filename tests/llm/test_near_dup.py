import random
import re

import pytest

from loadlens.llm import near_dup
from loadlens.llm.components import components
from loadlens.llm.near_dup import near_duplicates


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 3:
        return {tuple(words)} if words else set()
    return set(zip(words, words[1:], words[2:]))


def brute(rows):
    """(n_shingles, component) by id, over all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        if rng.random() < 0.5:
            words[at] = f"z{rng.randrange(10**6)}"
        else:
            del words[at : at + 3]
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 120))) for _ in range(40)]
    # A family whose members are now nearer, now further from each other than the limit.
    base = rng.choices(vocabulary, k=120)
    texts += [edited(rng, base, rng.randrange(0, 10)) for _ in range(120)]
    # A chain: each differs a little from the one before.
    chain = " ".join(rng.choices(vocabulary, k=100))
    for _ in range(12):
        texts.append(chain)
        chain = edited(rng, chain.split(), 2)
    texts += [texts[3].upper(), texts[3].replace(" ", "\n\t"), texts[3]] * 3
    texts += ["", None, " \n", "one", "One", "one two", "one  TWO", "É x y", "é x y"]
    texts += ["ha " * 5000, "ha " * 9000]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts))


def test_against_brute_force(documents, corpus):
    want = {i: (n, c, c == i) for i, (n, c) in brute(corpus).items()}
    docs = documents(corpus).withColumnRenamed("n_chars", "component_id")
    assert result(near_duplicates(docs)) == want


def test_small_blocks_find_the_same(documents, corpus, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    want = {i: (n, c, c == i) for i, (n, c) in brute(corpus).items()}
    assert result(near_duplicates(documents(corpus))) == want


def test_ids_that_are_null_or_repeated(documents):
    docs = documents([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, "a b c d")])
    rows = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert rows == [(0, None, True), (0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]


def test_empty_table(documents):
    assert near_duplicates(documents([])).count() == 0


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 9), (10, 11), (7, 7), (None, 1), (20, 21), (21, 22), (22, 20)]
    edges += [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 3 for n in (3, 4, 5, 9)} | {10: 10, 11: 10} | {n: 20 for n in (20, 21, 22)}
    assert got == want | {100 + i: 100 for i in range(31)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_under_one_id_are_judged_apart(documents):
    def text(name):
        return " ".join(f"{name}{i}" for i in range(60))

    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (7, text("c")), (7, text("d")), (7, text("d")),
            (8, text("d")), (9, text("b") + " more"), (None, text("a")), (4, None), (4, ""), (4, "")]
    for shuffled in (rows, rows[::-1]):
        kept = near_dup.drop_near_duplicates(documents(shuffled))
        assert kept.columns == documents([]).columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        texts = [t for _, t in got]
        one_b = [t for t in texts if t in (text("b"), text("b") + " more")]
        assert len(one_b) == 1 and len(got) == 7
        assert (3, text("a")) in got and (5, text("a")) not in got and (None, text("a")) in got
        assert (7, text("c")) in got and sum(t == text("d") for t in texts) == 1
        assert got.count((4, None)) == 1 and got.count((4, "")) == 1


def test_pairs_that_only_short_codes_hold_near_are_refused(documents, monkeypatch):
    """With 6 bits of each shingle most pairs seem near; full sets decide, all pairs if need be."""
    whole = near_dup._shorten

    def narrow():
        import numpy as np
        import pyarrow as pa

        def run(batches):
            for batch in whole()(batches):
                cut = [np.frombuffer(x.as_py(), np.uint32) >> 26 for x in batch.column("short")]
                cut = pa.array([x.astype(np.uint32).tobytes() for x in cut], pa.binary())
                yield batch.set_column(batch.schema.get_field_index("short"), "short", cut)

        return run

    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    rows = list(enumerate(edited(rng, base, rng.randrange(0, 9)) for _ in range(60)))
    want = {i: (n, c, c == i) for i, (n, c) in brute(rows).items()}
    assert len({c for _, c, _ in want.values()}) > 3
    monkeypatch.setattr(near_dup, "_shorten", narrow)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 400)
    assert result(near_duplicates(documents(rows))) == want


def test_only_documents_whose_rarest_shingles_meet_are_clustered(documents, monkeypatch):
    """Half-alike documents with enough shingles of their own meet in buckets, but no more."""
    monkeypatch.setattr(near_dup, "FREQUENCY_BITS", 4, raising=False)  # counters that all shingles share
    rng = random.Random(3)
    texts = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(140)]
        for member in range(5):
            own = [f"f{family}m{member}o{i}" for i in range(30)]
            texts.append(" ".join(base + own))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    made, whole = {}, near_dup.session.materialise

    def kept(df, purpose):
        made[purpose] = whole(df, purpose)
        return made[purpose]

    monkeypatch.setattr(near_dup.session, "materialise", kept)
    want = {i: (n, c, c == i) for i, (n, c) in brute(rows).items()}
    assert len({c for _, c, _ in want.values()}) == len(rows)
    assert result(near_duplicates(documents(rows))) == want
    assert made["open-documents"].count() == len(rows)
    assert made["rare-shingles"].count() == 0
    assert "cluster-blocks" not in made
