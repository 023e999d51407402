"""Token counts of a byte-level pair encoding by rank-synchronous merging of arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The split pattern of this family of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# A mark that, after letters and at the end of a chunk, is a pre-token of one byte.
MARKS = frozenset(",.")
# Counted pre-tokens a worker remembers before it starts anew; results don't depend on it.
REMEMBERED = 400_000
# Texts whose unknown pre-tokens are merged together, in characters.
ROUND_CHARS = 4 << 20


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, by a rule:
    printable bytes stand for themselves, the others take code points from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    names = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in plain)
    return names | {chr(256 + i): b for i, b in enumerate(rest)}


class PairRanks:
    """Merges of a vocabulary: id of every byte, and rank and result of every pair."""

    def __init__(self, vocabulary: bytes) -> None:
        told = json.loads(vocabulary)
        vocab = told["model"]["vocab"]
        self.bytes = np.zeros(256, dtype=np.int64)
        for name, byte in byte_names().items():
            self.bytes[byte] = vocab[name]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.results = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = [t["content"] for t in told["added_tokens"]]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a value past all ranks where there is no merge."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))


def merged_lengths(pieces: list[bytes], merges: PairRanks) -> np.ndarray:
    """Symbols left in each piece when no merge applies any more.

    All pieces lie in one ragged array. In each round every piece takes its own lowest-ranked
    pair and merges all its occurrences, left to right; finished pieces leave the array.
    """
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    result = lengths.copy()
    alive = np.flatnonzero(lengths > 1)
    symbols = merges.bytes[np.frombuffer(b"".join(pieces[i] for i in alive), dtype=np.uint8)]
    sizes = lengths[alive]
    none = len(merges.keys)
    rank = np.full(len(symbols), none, dtype=np.int64)  # of each symbol with the next one
    rank[:-1] = merges.rank(symbols[:-1], symbols[1:])
    while len(alive):
        starts = np.cumsum(sizes) - sizes
        rank[starts[1:] - 1] = none  # a pair never spans two pieces
        rank[-1] = none
        lowest = np.minimum.reduceat(rank, starts)
        taken = (rank == np.repeat(lowest, sizes)) & (rank < none)
        # Of touching occurrences (a a a) every second one merges, from the left.
        places = np.flatnonzero(taken)
        if len(places):
            fresh = np.ones(len(places), dtype=bool)
            fresh[1:] = np.diff(places) > 1
            run = np.cumsum(fresh) - 1
            places = places[(places - places[fresh][run]) % 2 == 0]
        symbols[places] = merges.results[rank[places]]
        stays = np.ones(len(symbols), dtype=bool)
        stays[places + 1] = False
        changed = np.zeros(len(symbols), dtype=bool)
        changed[places] = True
        left = np.maximum.accumulate(np.where(stays, np.arange(len(stays)), 0))
        changed[left[np.maximum(places - 1, 0)]] = True  # the symbol before a merged one
        sizes = np.add.reduceat(stays.astype(np.int64), starts)
        result[alive] = sizes
        going = (lowest < none) & (sizes > 1)
        stays &= np.repeat(going, np.diff(starts, append=len(symbols)))
        symbols, rank, changed = symbols[stays], rank[stays], np.flatnonzero(changed[stays])
        alive, sizes = alive[going], sizes[going]
        changed = changed[changed < len(symbols) - 1]
        rank[changed] = merges.rank(symbols[changed], symbols[changed + 1])
    return result


class TokenCounter:
    """Counts tokens of texts; chunks seen before are looked up.

    A space before a character that is no white space always begins a pre-token, so a text
    is cut there into chunks, most of them a word, whose tokens can be counted alone.
    """

    def __init__(self, vocabulary: bytes) -> None:
        self.merges = PairRanks(vocabulary)
        self.split = regex.compile(PATTERN).findall
        self.no_cut = regex.compile(r" (?=\s|$)").search
        self.cut = regex.compile(r"(?<!^) (?=\S)").split
        self.known: dict[str, int] = {}

    def _chunks(self, text: str) -> tuple[list[str], int]:
        """Chunks without the space that begins each but the first of a section; specials."""
        parts, specials = [text], 0
        for string in self.merges.special:
            if string in text:
                parts = [p for part in parts for p in part.split(string)]
                specials += text.count(string)
        chunks: list[str] = []
        for part in parts:
            own = self.cut(part) if self.no_cut(part) else part.split(" ")
            # No other chunk begins with a space: one marks the first, which has none before it.
            chunks.append(" " + own[0])
            chunks += own[1:]
        return chunks, specials

    def _learn(self, chunks: list[str]) -> None:
        """Count the tokens of chunks not seen before.

        A chunk of letters is one pre-token, with a comma or full stop after it two; the
        pattern cuts all others.
        """
        stems = {c: c if c.isalpha() else c[:-1] for c in chunks if c[-1:].isalpha() or c[-1:] in MARKS}
        stems = {c: stem for c, stem in stems.items() if stem.isalpha()}
        pieces = {
            c: self.split(c[1:] if c[:1] == " " else " " + c) for c in chunks if c not in stems
        }
        new = [*({*stems.values()} - self.known.keys())]
        odd = [*{p for own in pieces.values() for p in own}]
        sizes = merged_lengths([*((" " + s).encode() for s in new), *map(str.encode, odd)], self.merges)
        self.known.update(zip(new, sizes[: len(new)].tolist()))
        known, size = self.known, dict(zip(odd, sizes[len(new) :].tolist()))
        for chunk, stem in stems.items():
            known[chunk] = known[stem] + (chunk != stem)
        for chunk, own in pieces.items():
            known[chunk] = sum(map(size.__getitem__, own))

    def _round(self, texts: list[str]) -> list[int]:
        cut = [self._chunks(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = {c for own, _ in cut for c in own} - self.known.keys()
        if new:
            self._learn(list(new))
        known = self.known.__getitem__
        return [specials + sum(map(known, own)) for own, specials in cut]

    def count(self, texts: list[str]) -> list[int]:
        result: list[int] = []
        waiting: list[str] = []
        chars = 0
        for text in texts:
            waiting.append(text)
            chars += len(text)
            if chars >= ROUND_CHARS:
                result += self._round(waiting)
                waiting, chars = [], 0
        return result + self._round(waiting)


def token_counts(
    documents: DataFrame, vocabulary: str | Path, keep: list[str], *, text: str = "text"
) -> DataFrame:
    """Add n_bytes (UTF-8) and n_tokens of whole texts.

    `vocabulary` is the file of a byte-level pair encoding, read on the driver; its content
    has a fixed size and is broadcast. Special strings inside a text count as one token each,
    as the vocabulary's library does by default; nothing is added or truncated.

    Null and empty texts have 0 bytes and 0 tokens. Returns the columns `keep` and the two
    counts, which replace input columns of these names; each row is counted for itself.
    """
    spark = documents.sparkSession
    table = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(table.value)
        for batch in batches:
            texts = batch.column(text).fill_null("")
            sizes = pc.binary_length(texts).cast(pa.int64())
            tokens = pa.array(counter.count(texts.to_pylist()), pa.int64())
            columns = [*(batch.column(c) for c in keep), sizes, tokens]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_bytes", "n_tokens"])

    fields = {f.name: f for f in documents.schema}
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    schema = T.StructType([*(fields[c] for c in keep), *added])
    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
