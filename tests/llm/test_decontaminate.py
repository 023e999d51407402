import hashlib
import random
import re

from loadlens.llm import decontaminate
from loadlens.llm.decontaminate import drop_contaminated, find_passages

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORDS.findall(lowered)


def brute(text, items, window=13):
    doc, hit, found = words(text), set(), set()
    for item, passage in items:
        own = words(passage)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            for j in range(len(doc) - size + 1):
                if doc[j : j + size] == own[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add("" if item is None else str(item))
    return len(doc), sorted(hit), sorted(found)


def result(df):
    return {r.doc_id: (r.n_words, r.hit_words, r.items) for r in df.collect()}


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force_in_one_and_many_passes(spark, documents):
    rng = random.Random(5)
    vocabulary = ["ab", "Ä", "7", "xyz", "ß", "q"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 5, 13, 14, 30])))) for i in range(12)]
    items += [(3, items[3][1]), (99, "?!"), (98, None), (None, "null id here")]
    texts = [", ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(40)]
    texts += [items[i][1].upper().replace(" ", "\n") + " tail" for i in range(8)] + ["Null ID here"]
    texts += ["", None, "....", "ab" * 3000, "ab " * 4000]
    docs = documents(texts)
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    assert result(find_passages(docs, bench(spark, items), ["doc_id"])) == want
    many = find_passages(docs, bench(spark, items), ["doc_id"], slice_bytes=150)
    assert result(many) == want


def test_empty_tables(spark, documents):
    none = bench(spark, [])
    assert result(find_passages(documents(["a b"]), none, ["doc_id"])) == {0: (2, [], [])}
    assert find_passages(documents([]), bench(spark, [(1, "a")]), ["doc_id"]).count() == 0


def test_drop_contaminated_keeps_columns_and_repeated_rows(spark, documents):
    passage = " ".join(f"w{i}" for i in range(20))
    filler = " ".join(f"x{i}" for i in range(300))
    docs = documents([passage, (1, "clean text"), (1, "clean text"), (None, None), f"{filler} {' '.join(passage.split()[:13])}"])
    # 13 of 313 words are hit: under one in twenty.
    kept = drop_contaminated(docs, bench(spark, [(1, passage)]))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 1, 1, 4]
    named = docs.withColumnsRenamed({"lang": "n_words", "source": "items", "n_chars": "row"})
    assert drop_contaminated(named, bench(spark, [(1, passage)])).columns == named.columns
    assert find_passages(named, bench(spark, [(1, passage)]), named.columns).count() == 5


def test_shift_table_skips(spark):
    (search,) = decontaminate.matchers([("1", " ".join(f"w{i}" for i in range(13)))])
    assert search.length == 13 and search.shifts.max() == 12
    assert hashlib.sha256(b"").hexdigest()  # what an empty item list digests to
