"""Every stage of the pipeline against a plain version of it, each on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_decontaminate import words as plain_words
from test_mixing import targets
from test_near_dup import brute as near_brute

from loadlens import session
from loadlens.llm import quality
from loadlens.llm.mixing import Mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    """Input and output rows of all stages on the smallest tables, and the result of run()."""
    docs, steps = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = session.materialise(stage(spark, docs, sf_dir), "stage")
        steps.append((name, docs.collect(), out.collect(), out.columns))
        docs = out
    return steps, corpus_pipeline.run(spark, sf_dir).collect()


def test_columns_and_order(tables):
    steps, final = tables
    assert [c for *_, c in steps] == [COLUMNS] * 3 + [[*COLUMNS, "copy"]]
    assert sorted(map(repr, final)) == sorted(map(repr, steps[-1][2]))
    for (_, _, out, _), (_, rows, _, _) in zip(steps, steps[1:]):
        assert sorted(map(repr, out)) == sorted(map(repr, rows))


def test_quality_stage(tables, spark, sf_dir):
    _, rows, out, _ = tables[0][0]
    kept = {r.doc_id for r in out}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert kept == {r.doc_id for r in judged if r.kept}
    for row in rows:
        own = row.text.split()
        windows = Counter(tuple(own[i : i + 5]) for i in range(len(own) - 4))
        covered = {
            j for i in range(len(own) - 4) if windows[tuple(own[i : i + 5])] > 1 for j in range(i, i + 5)
        }
        if len(own) < 10 or 100 * len(covered) > 20 * len(own):
            assert row.doc_id not in kept


def test_near_dedup_stage(tables):
    _, rows, out, _ = tables[0][1]
    classes = near_brute([(r.doc_id, r.text) for r in rows])
    assert sorted(r.doc_id for r in out) == sorted(i for i, (_, c) in classes.items() if i == c)


def test_decontamination_stage(tables, spark, sf_dir):
    _, rows, out, _ = tables[0][2]
    passages = set()
    for item in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        own = plain_words(item.text)
        size = min(13, len(own))
        passages |= {tuple(own[i : i + size]) for i in range(len(own) - size + 1) if size}
    sizes = {len(p) for p in passages}
    clean = set()
    for row in rows:
        own = plain_words(row.text)
        hit = {
            j
            for size in sizes
            for i in range(len(own) - size + 1)
            if tuple(own[i : i + size]) in passages
            for j in range(i, i + size)
        }
        if not hit or 20 * len(hit) < len(own):
            clean.add(row.doc_id)
    assert {r.doc_id for r in out} == clean


def test_mixing_stage(tables):
    _, rows, out, _ = tables[0][3]
    sizes, want = targets([tuple(r) for r in rows], Mix())
    taken, largest, times = defaultdict(int), defaultdict(int), Counter()
    for r in rows:
        largest[r.source] = max(largest[r.source], len(re.findall(r"[^\x20\x09-\x0D]+", r.text)))
    for r in out:
        taken[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 2 * largest[source]


def test_stages_take_odd_tables(documents, spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0)]
    rows += [(2, "word " * 30000, "en", None, 1), (3, "a b c " * 4, "en", "s", 1), (3, "a b c " * 4, "en", "s", 1)]
    rows += [(i, " ".join(f"v{i}x{j}" for j in range(40)), "en", "s", 1) for i in range(5, 9)] * 2
    for table in (documents(rows), documents([]), documents(rows).withColumnsRenamed({"n_chars": "copy"})):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()


def test_one_row_of_a_repeated_document_stays(documents, spark, sf_dir):
    text = " ".join(f"v{j}" for j in range(40))
    docs = documents([(5, text), (5, text), (6, text), (None, text)])
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 5]
