"""Benchmark passages inside documents, found by Wu-Manber search over words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens import session
from loadlens.llm.batches import WordCoder, blocks, mix, plain_words, word_spans

WINDOW_WORDS = 13
# Benchmark text one pass takes. A larger benchmark is searched for in several passes over
# the documents, so what is sent to the workers has this bound.
SLICE_BYTES = 32 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_words", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


class WuManber:
    """Patterns of one length over word codes.

    `shifts` tells, for a hashed block of two words, how far the search may move on without
    missing a pattern: 0 means that some pattern ends in such a block. Those positions look
    into the bucket of patterns with this last block, narrowed by a code of the whole
    pattern, and compare word by word.
    """

    def __init__(self, patterns: np.ndarray, owners: list[list[str]]) -> None:
        count, self.length = patterns.shape
        self.block = min(2, self.length)
        self.bits = max(10, int(math.log2(count * self.length + 1)) + 4)
        self.shifts = np.full(1 << self.bits, self.length - self.block + 1, dtype=np.int64)
        for start in range(self.length - self.block + 1):
            slots = self._slots(self._block(patterns[:, start : start + self.block]))
            np.minimum.at(self.shifts, slots, self.length - self.block - start)
        keys = self._key(patterns)
        order = np.argsort(keys, kind="stable")
        self.keys, self.patterns = keys[order], patterns[order]
        self.owners = [owners[i] for i in order]

    def _block(self, words: np.ndarray) -> np.ndarray:
        code = words[..., 0]
        for i in range(1, self.block):
            code = mix(code) + words[..., i]
        return mix(code)

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return (codes >> np.uint64(64 - self.bits)).astype(np.int64)

    def _key(self, words: np.ndarray) -> np.ndarray:
        """Bucket in the upper half, code of the whole pattern in the lower half."""
        whole = np.zeros(len(words), dtype=np.uint64)
        for i in range(self.length):
            whole = mix(whole + words[:, i])
        suffix = self._block(words[:, self.length - self.block :])
        return (suffix & np.uint64(0xFFFFFFFF00000000)) | (whole >> np.uint64(32))

    def search(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and patterns of all occurrences inside the texts that `bounds` cuts.

        All texts are searched in step: each keeps the position of its current block.
        """
        at = bounds[:-1] + self.length - self.block
        stop = bounds[1:] - self.block + 1
        live = at < stop
        at, stop = at[live], stop[live]
        places: list[np.ndarray] = []
        while len(at):
            slots = self._slots(self._block(codes[at[:, None] + np.arange(self.block)]))
            step = self.shifts[slots]
            if (ends := at[step == 0]).size:
                places.append(ends - (self.length - self.block))
            at = at + np.maximum(step, 1)
            live = at < stop
            if not live.all():
                at, stop = at[live], stop[live]
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.concatenate(places)
        words = codes[first[:, None] + np.arange(self.length)]
        keys = self._key(words)
        low = np.searchsorted(self.keys, keys, side="left")
        high = np.searchsorted(self.keys, keys, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while (more := low < high).any():
            first, words, low, high = first[more], words[more], low[more], high[more]
            same = (self.patterns[low] == words).all(axis=1)
            found.append((first[same], low[same]))
            low = low + 1
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def matchers(items: list[tuple[str, str]], window: int = WINDOW_WORDS) -> list[WuManber]:
    """Searches for the windows of benchmark items, one for each pattern length."""
    coder, word_class = WordCoder(), plain_words()
    by_length: dict[int, dict[bytes, tuple[np.ndarray, set[str]]]] = {}
    for item, text in items:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), word_class)
        codes = coder.codes(data, starts, ends)
        length = min(window, len(codes))
        for i in range(len(codes) - length + 1 if length else 0):
            one = codes[i : i + length]
            by_length.setdefault(length, {}).setdefault(one.tobytes(), (one, set()))[1].add(item)
    return [
        WuManber(np.stack([p for p, _ in own.values()]), [sorted(o) for _, o in own.values()])
        for own in by_length.values()
    ]


def _scan(text: str, keep: list[str], again: bool, table, window: int):
    """Worker function over Arrow batches; `table` is the broadcast list of items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, coder, word_class = matchers(table.value, window), WordCoder(), plain_words()
        for batch in batches:
            n_words, hits, items = [], [], []
            for first, end, data, offsets in blocks(batch.column(text)):
                starts, ends, bounds = word_spans(data, offsets, word_class)
                codes = coder.codes(data, starts, ends)
                edges = np.zeros(len(codes) + 1, dtype=np.int64)
                owners: dict[int, set[str]] = {}
                for search in searches:
                    at, which = search.search(codes, bounds)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + search.length, -1)
                    rows = np.searchsorted(bounds, at, side="right") - 1
                    for row, pattern in set(zip(rows.tolist(), which.tolist())):
                        owners.setdefault(row, set()).update(search.owners[pattern])
                hit = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
                cuts = np.searchsorted(hit, bounds)
                n_words += np.diff(bounds).tolist()
                for row in range(end - first):
                    own = (hit[cuts[row] : cuts[row + 1]] - bounds[row]).tolist()
                    named = owners.get(row, set())
                    if again:
                        before = batch.column("hit_words")[first + row].as_py()
                        own = sorted({*own, *before})
                        named = named | {*batch.column("items")[first + row].as_py()}
                    hits.append(own)
                    items.append(sorted(named))
            columns = [batch.column(name) for name in keep]
            columns += [
                pa.array(n_words, pa.int64()),
                pa.array(hits, pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *FOUND.names])

    return run


def find_passages(
    documents: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    *,
    text: str = "text",
    window: int = WINDOW_WORDS,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Add what each document shares with benchmark items.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A passage is
    `window` consecutive words of an item, or the whole of a shorter one. Returns the columns
    `keep` with n_words, hit_words (positions of words inside any occurrence) and items (ids
    as strings, each once, sorted); input columns of these three names are replaced.

    Null and empty texts have no words; an item without words occurs nowhere; a null item id
    stands as an empty string; items with the same id count as one. Every row keeps its own
    result, repeated rows too. An empty benchmark hits nothing.
    """
    spark = documents.sparkSession
    session.small_arrow_batches(spark)
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    slices = max(1, math.ceil(2 * total / slice_bytes)) if total > slice_bytes else 1
    keep = [c for c in keep if c not in FOUND.names]
    carry = list(dict.fromkeys([*keep, text]))
    fields = {f.name: f for f in documents.schema}
    result = documents.select(*carry)
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        table = spark.sparkContext.broadcast([(r.item, r.text) for r in part.collect()])
        last = k == slices - 1
        out = keep if last else carry
        schema = T.StructType([*(fields[c] for c in out), *FOUND.fields])
        result = result.mapInArrow(_scan(text, out, k > 0, table, window), schema)
        if not last:  # one pass per stage: a worker never holds two tables
            result = session.materialise(result, "passages")
    return result


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least one word in twenty lies inside a passage."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their own columns.

    Columns are carried in one struct, so names of any kind are safe. Edge cases are those of
    `find_passages`; an empty table stays empty.
    """
    packed = documents.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    found = find_passages(packed, benchmark, ["row"])
    clean = ~is_contaminated(F.col("n_words"), F.size("hit_words"))
    return found.where(clean).select("row.*")
