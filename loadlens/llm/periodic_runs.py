"""Periodic runs of words in texts, by recompression.

A sequence of words is turned into a run-length grammar: blocks of one symbol and pairs of two
symbols are replaced alternately until one symbol stands for each text. The same stretch of
words is replaced in the same way wherever it stands, but for its ends, so the grammar tells in
a few steps per level how far two places agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loadlens.llm import batches

# Bytes of text whose words form one grammar (one whole text at least).
GRAMMAR_BYTES = 4 << 20
# Grid places, and pairs of places, that are looked at together.
GRID_PLACES = 2 << 20
PAIRS = 1 << 19

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
ADDED = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)),
        T.StructField("strongest", RUN),
        T.StructField("collapsed", T.StringType()),
    ]
)


def _named(keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """A symbol from `fresh` on for every distinct key, and the next unused symbol."""
    distinct, names = np.unique(keys, return_inverse=True)
    return (names + fresh).astype(np.int32), fresh + len(distinct)


class Grammar:
    """Levels of a run-length grammar over texts of word numbers.

    Level 0 is the words, with a mark (a negative symbol of its own) before, between and after
    the texts; marks are never replaced. Each further level replaces blocks or pairs of the
    level below: `start` has the first child of every symbol, and one entry more.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = [symbols]
        self.start: list[np.ndarray] = []  # start[k]: children at level k of symbols at k + 1
        self.parent: list[np.ndarray] = []
        self.blocks: list[bool] = []  # whether level k + 1 replaces blocks
        self.fresh = int(symbols.max(initial=0)) + 1
        rng = np.random.default_rng(20240713)
        while True:
            self._replace_blocks()
            own = self.symbols[-1]
            if not ((own[:-1] >= 0) & (own[1:] >= 0)).any():
                return
            self._replace_pairs(rng.integers(0, 2**64, dtype=np.uint64))

    def _push(self, begins: np.ndarray, symbols: np.ndarray, blocks: bool) -> None:
        self.parent.append(np.cumsum(begins, dtype=np.int32) - 1)
        ends = np.append(np.flatnonzero(begins), len(begins))
        self.start.append(ends.astype(np.int32))
        self.symbols.append(symbols)
        self.blocks.append(blocks)

    def _replace_blocks(self) -> None:
        own = self.symbols[-1]
        begins = np.ones(len(own), dtype=bool)
        begins[1:] = own[1:] != own[:-1]
        if begins.all():
            return
        places = np.flatnonzero(begins)
        sizes = np.diff(places, append=len(own))
        symbols = own[places]
        long = sizes > 1
        keys = symbols[long].astype(np.int64) << 32 | sizes[long]
        symbols[long], self.fresh = _named(keys, self.fresh)
        self._push(begins, symbols, True)

    def _replace_pairs(self, salt: np.uint64) -> None:
        """Replace neighbours of which the first is of one random half of the symbols, the
        second of the other: such pairs never overlap."""
        own = self.symbols[-1]
        half = batches.mix(own.astype(np.uint64) ^ salt) & np.uint64(1) == 1
        words = own >= 0
        both = words[:-1] & words[1:]
        one, other = both & half[:-1] & ~half[1:], both & ~half[:-1] & half[1:]
        first = np.flatnonzero(one if one.sum() >= other.sum() else other)
        if not len(first):
            return
        begins = np.ones(len(own), dtype=bool)
        begins[first + 1] = False
        symbols = own.copy()
        keys = own[first].astype(np.int64) << 32 | own[first + 1]
        symbols[first], self.fresh = _named(keys, self.fresh)
        self._push(begins, symbols[begins], False)

    def agree(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a and b on (or, backward, up to them) are equal.

        The places of a pair are different places of one text or the mark at its ends.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        begin = a.copy()
        sign = 1 if forward else -1

        def step(level: int, who: np.ndarray) -> None:
            """Go past equal symbols: in blocks, past what both still have of theirs."""
            by = np.ones(len(who), dtype=np.int64)
            if level < len(self.blocks) and self.blocks[level]:
                rest = []
                for x in (a[who], b[who]):
                    up, start = self.parent[level][x], self.start[level]
                    rest.append(start[up + 1] - x if forward else x - start[up] + 1)
                by = np.minimum(*rest)
            a[who] += sign * by
            b[who] += sign * by

        def at_edge(level: int, x: np.ndarray) -> np.ndarray:
            up, start = self.parent[level][x], self.start[level]
            return start[up] == x if forward else start[up + 1] - 1 == x

        # Upwards, as long as symbols are equal; `stopped[k]` differ at level k.
        stopped = []
        who = np.arange(len(a))
        for level, symbols in enumerate(self.symbols):
            here = [np.empty(0, dtype=np.int64)]
            rising = [np.empty(0, dtype=np.int64)]
            while len(who):
                equal = symbols[a[who]] == symbols[b[who]]
                here.append(who[~equal])
                who = who[equal]
                if level < len(self.parent):
                    ready = at_edge(level, a[who]) & at_edge(level, b[who])
                    rising.append(who[ready])
                    who = who[~ready]
                step(level, who)
            stopped.append(np.concatenate(here))
            who = np.concatenate(rising)
            if level < len(self.parent):
                a[who] = self.parent[level][a[who]]
                b[who] = self.parent[level][b[who]]
        # Downwards, to the first words that differ.
        who = np.empty(0, dtype=np.int64)
        for level in range(len(self.parent), 0, -1):
            who = np.concatenate([who, stopped[level]])
            start, symbols = self.start[level - 1], self.symbols[level - 1]
            for x in (a, b):
                x[who] = start[x[who]] if forward else start[x[who] + 1] - 1
            same = who[symbols[a[who]] == symbols[b[who]]]
            while len(same):
                step(level - 1, same)
                same = same[symbols[a[same]] == symbols[b[same]]]
        return sign * (a - begin)


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): owners 0 0 2 2 2 and numbers 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def grid_places(
    words: np.ndarray, begin: np.ndarray, size: np.ndarray, least: int, repeats: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods that a run of at least `repeats` periods may have.

    Such a run with period p holds `repeats` neighbouring multiples of p (counted from the
    text's begin), all with the same word. The multiples of all periods of a text of n words
    are some n log n.
    """
    periods = np.where(size >= least, size // repeats, 0)
    for first, end in _pieces(periods, GRID_PLACES):
        text, period = _ragged(periods[first:end])
        text, period = text + first, period + 1
        count = (size[text] - 1) // period - (repeats - 2)
        for one, last in _pieces(count, GRID_PLACES):
            own, number = _ragged(count[one:last])
            p = period[one:last][own]
            place = begin[text[one:last]][own] + number * p
            word = words[place]
            for k in range(1, repeats):
                same = words[place + k * p] == word
                place, p, word = place[same], p[same], word[same]
            yield place, p


def _pieces(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Spans of entries whose counts add up to about `limit`, one entry at least."""
    ends = np.cumsum(counts)
    first = 0
    while first < len(counts):
        reach = (ends[first - 1] if first else 0) + limit
        last = max(int(np.searchsorted(ends, reach, side="right")), first + 1)
        yield first, last
        first = last


def runs_of(
    texts: list[np.ndarray], least: int, repeats: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and period of every run, by text, start and period.

    Texts are arrays of word numbers from 0 on.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(size + 1) - size
    words = np.empty(int(size.sum()) + len(texts) + 1, dtype=np.int32)
    marks = np.append(begin - 1, len(words) - 1)
    words[marks] = -1 - np.arange(len(marks))
    for at, own in zip(begin, texts):
        words[at : at + len(own)] = own
    grammar = None
    found = []
    for place, period in grid_places(words, begin, size, least, repeats):
        if grammar is None and len(place):
            grammar = Grammar(words)
        for k in range(0, len(place), PAIRS):
            a, p = place[k : k + PAIRS], period[k : k + PAIRS]
            start = a - grammar.agree(a - 1, a + p - 1, forward=False)
            end = a + p + grammar.agree(a, a + p, forward=True)
            good = end - start >= np.maximum(least, repeats * p)
            found.append(np.unique(np.stack([start[good], end[good], p[good]]), axis=1))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    # Multiples of the smallest period give the same stretch.
    start, end, period = np.unique(np.concatenate(found, axis=1), axis=1)
    smallest = np.ones(len(start), dtype=bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    text = np.searchsorted(begin, start, side="right") - 1
    order = np.lexsort((period, start))
    return text[order], (start - begin[text])[order], (end - start)[order], period[order]


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Words of each text, and their numbers: equal words, equal numbers."""
    words = [text.split() for text in texts]  # at 0x20 and 0x09 to 0x0D
    numbers = {w: i for i, w in enumerate(dict.fromkeys(w for own in words for w in own))}
    return words, [
        np.fromiter(map(numbers.__getitem__, own), dtype=np.int32, count=len(own)) for own in words
    ]


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; ties: smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that stand in no run after its first period, joined by one space."""
    if runs:
        kept = np.ones(len(words), dtype=bool)
        for start, length, period in runs:
            kept[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(kept)]
    return b" ".join(words).decode()


def find_runs(
    documents: DataFrame, keep: list[str], *, text: str = "text", least: int = 24, repeats: int = 3
) -> DataFrame:
    """All maximal periodic runs of words `[^\\x20\\x09-\\x0D]+` in whole texts.

    A run is a stretch of consecutive words whose smallest period is p, of at least
    max(`least`, `repeats` * p) words, that no neighbouring word extends with this period.
    `repeats` is 2 at least. Adds

    - n_words: words of the text,
    - runs: (start, length, period) of every run in words, from 0, by start and period,
    - strongest: the run with the greatest length / period, ties: smallest start, then period,
    - collapsed: the words joined by one space, without those that stand in some run after
      its first period.

    Null and empty texts have no words, no runs, a null `strongest` and an empty `collapsed`.
    Rows are judged one by one, so repeated rows get the same; an empty table gives an empty
    table. A text's grammar has to fit the memory of its task: some 200 bytes a word. Returns
    the columns `keep` and the four, which replace input columns of these names.
    """
    if repeats < 2:
        raise ValueError("a run repeats its period at least twice")
    keep = [c for c in keep if c not in ADDED.names]
    fields = {f.name: f for f in documents.schema}
    schema = T.StructType([*(fields[c] for c in keep), *ADDED])
    run_type = pa.struct([(name, pa.int64()) for name in RUN.names])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column = batch.column(text)
            for first, end, data, offsets in batches.blocks(column, GRAMMAR_BYTES):
                raw = data.tobytes()
                words, numbers = _numbered([raw[a:b] for a, b in zip(offsets, offsets[1:])])
                owner, *found = runs_of(numbers, least, repeats)
                at = np.searchsorted(owner, np.arange(len(words) + 1))
                spelled = list(zip(*(f.tolist() for f in found)))
                runs = [spelled[a:b] for a, b in zip(at, at[1:])]
                values = pa.StructArray.from_arrays(
                    [pa.array(f, pa.int64()) for f in found], names=RUN.names
                )
                strongest = [r and dict(zip(RUN.names, r)) for r in map(_strongest, runs)]
                own = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(own.column(c) for c in keep),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.ListArray.from_arrays(at.astype(np.int32), values),
                        pa.array(strongest, run_type),
                        pa.array(map(_collapsed, words, runs), pa.string()),
                    ],
                    names=[*keep, *ADDED.names],
                )

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)
