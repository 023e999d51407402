import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loadlens.llm import token_counts as tc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


TEXTS = [
    "", " ", "  a", "a ", "\n\n a", " \n\n  x\t\t", "\0 x", " \0a b", "don't we'll  I'M",
    "a   b 　c", "a \x1c\x1db \x85c", "日本語テキスト😀😀 한국어", "aaaa" * 700, "ab" * 5000,
    "<|endoftext|>", " a<|endoftext|> b ", "<|endoftext|><|endoftext|>x", "<|endof text|>",
    "x, y. z! 12,5 3.14 ,. a,, b..", "été ½ ² Ⅷ ǅ", "word," * 300,
]


def test_counts_equal_the_library(library):
    counter = tc.TokenCounter(open(VOCABULARY, "rb").read())
    assert counter.count(TEXTS) == library(TEXTS)
    rng = random.Random(1)
    pieces = ["the", " ", "  ", "\n", "Ing", ",", ".", "'s", "é", "1", "😀", "<|endoftext|>", "\t", "an"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(500)]
    assert counter.count(texts) == library(texts)


def test_forgetting_does_not_change_counts(library, monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 3)
    monkeypatch.setattr(tc, "ROUND_CHARS", 10)
    counter = tc.TokenCounter(open(VOCABULARY, "rb").read())
    assert counter.count(TEXTS) == library(TEXTS)


def test_rows(documents, library):
    texts = [*TEXTS, None]
    docs = documents(texts).withColumnRenamed("n_chars", "n_tokens")
    rows = tc.token_counts(docs, VOCABULARY, ["doc_id", "n_tokens"]).collect()
    want = library([t or "" for t in texts])
    assert [(r.n_bytes, r.n_tokens) for r in sorted(rows)] == [
        (len((t or "").encode()), n) for t, n in zip(texts, want)
    ]
    assert tc.token_counts(documents([]), VOCABULARY, ["doc_id"]).count() == 0
