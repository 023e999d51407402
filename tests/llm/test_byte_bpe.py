import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

from loadlens.llm import byte_bpe, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    lines = open(RANKS, "rb").read().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.read(RANKS)


def ids(encoder, texts):
    return [memoryview(raw).cast("i").tolist() for raw in encoder.encode(texts)]


TEXTS = [
    "", " ", "  a", "a ", "\n\n a", " \n\n  x\t\t", "\0 x", " \0a b", "don't we'll  I'M",
    "a   b 　c", "a \x1c\x1db \x85c", "日本語テキスト😀😀 한국어", "aaaa" * 700, "ab" * 5000,
    "<|endoftext|>", "x, y. z! 12,5 3.14 ,. a,, b..", "été ½ ² Ⅷ ǅ", "word," * 300,
    " " * 5000, "=" * 3001, "the" * 999, "\n" * 700 + "x",
]


def noise(count, seed):
    rng = random.Random(seed)
    pieces = ["the", " ", "  ", "\n", "Ing", ",", ".", "'s", "é", "1", "😀", "\t", "an", "aa", "日本"]
    return ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(count)]


def test_ids_equal_the_library(library, vocabulary):
    encoder = byte_bpe.Encoder(vocabulary, PATTERN)
    letters = random.Random(2)
    texts = [*TEXTS, *noise(500, 1), "".join(letters.choices("etaoinshrdl", k=4000))]
    assert ids(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_both_queries_agree(library, vocabulary, monkeypatch):
    texts = [t for t in [*TEXTS, *noise(100, 3)] if len(t) < 400]
    want = [library.encode_ordinary(t) for t in texts]
    assert vocabulary.ordered
    for long in (1, 10**9):
        monkeypatch.setattr(byte_bpe, "LONG", long)
        assert ids(byte_bpe.Encoder(vocabulary, PATTERN), texts) == want


def test_bounds_do_not_change_ids(library, vocabulary, monkeypatch):
    for name, value in (("REMEMBERED", 2), ("QUERY_BYTES", 7), ("QUERY_ROUNDS", 2)):
        monkeypatch.setattr(byte_bpe, name, value)
    texts = [t for t in TEXTS if len(t) < 400]
    encoder = byte_bpe.Encoder(vocabulary, PATTERN)
    for some in (texts[:9], texts[9:]):
        assert ids(encoder, some) == [library.encode_ordinary(t) for t in some]


def write_ranks(path, tokens):
    lines = (f"{base64.b64encode(t).decode()} {rank}" for rank, t in enumerate(tokens))
    path.write_text("\n".join(lines) + "\n")
    return path


def test_a_vocabulary_out_of_order(tmp_path):
    """Where a merge makes a pair of lower rank, places are contracted one by one."""
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab"]
    ranks = {t: r for r, t in enumerate(tokens)}
    vocabulary = byte_bpe.Vocabulary.read(write_ranks(tmp_path / "ranks", tokens))
    assert not vocabulary.ordered
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["abcabc", "abab" * 40 + "c", "cabcab" * 30]
    assert ids(byte_bpe.Encoder(vocabulary, PATTERN), texts) == [own.encode_ordinary(t) for t in texts]


def test_rows_and_round_trip(documents, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ROUND_TOKENS", 500)
    texts = [None, *TEXTS, "again", "again"]
    docs = documents(texts).withColumnRenamed("n_chars", "ids")
    encoded = byte_bpe.encode(docs, RANKS, PATTERN, ["doc_id", "ids"])
    assert encoded.columns == ["doc_id", "ids"]
    rows = {r.doc_id: r.ids for r in encoded.collect()}
    assert [rows[i] for i in range(len(texts))] == [library.encode_ordinary(t or "") for t in texts]
    back = {r.doc_id: bytes(r.bytes) for r in byte_bpe.decode(encoded, RANKS, ["doc_id"]).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").encode() for t in texts]
    both = byte_bpe.encode(docs.withColumnRenamed("lang", "bytes"), RANKS, PATTERN, ["doc_id", "bytes"], back=True)
    assert both.columns == ["doc_id", "ids", "bytes"]
    assert {r.doc_id: (r.ids, bytes(r.bytes)) for r in both.collect()} == {i: (rows[i], back[i]) for i in rows}
    empty = byte_bpe.encode(documents([]), RANKS, PATTERN, ["doc_id"])
    assert byte_bpe.decode(empty, RANKS, ["doc_id"]).count() == 0


def test_odd_ids_decode_to_nothing(spark):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("bytes", T.StringType())])
    rows = [(1, None, "x"), (2, [], None), (3, [None, 64, 10**8, -1, 64], "y"), (3, [64], "y")]
    decoded = byte_bpe.decode(spark.createDataFrame(rows, schema), RANKS, ["k", "bytes"])
    token = byte_bpe.Vocabulary.read(RANKS).tokens[64]
    found = sorted((r.k, bytes(r.bytes)) for r in decoded.collect())
    assert found == [(1, b""), (2, b""), (3, token), (3, token * 2)]


def test_query_against_the_library(spark, sf_dir, library):
    import hashlib

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own = library.encode_ordinary(r.text or "")
        digest = hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        want[r.doc_id] = (len(own), digest, hashlib.sha256(library.decode_bytes(own)).hexdigest())
    rows = queries.QUERIES["op11_byte_bpe"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
