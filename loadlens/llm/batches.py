"""Texts of an Arrow batch as byte arrays, and their words as 64-bit codes.

Word classes work on UTF-8 bytes: every byte above 0x7F belongs to a character that both
classes count as part of a word, so no decoding is needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# A block is worked on in some twenty arrays of eight bytes a word or byte: one of 512 KB takes a
# worker 30 MB.
BLOCK_BYTES = 512 << 10


def _byte_class(no_word: list[range]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for span in no_word:
        table[span.start : span.stop] = False
    return table


def spaced_words() -> np.ndarray:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return _byte_class([range(0x20, 0x21), range(0x09, 0x0E)])


def plain_words() -> np.ndarray:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text whose A-Z were lower-cased."""
    table = _byte_class([range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)])
    table[ord("A") : ord("Z") + 1] = True
    return table


def lower_bytes() -> np.ndarray:
    """Table that lower-cases A-Z and leaves all other bytes."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null is an empty text."""
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.empty(0, np.uint8)
    return data, offsets


def blocks(
    column: pa.Array, limit: int = BLOCK_BYTES
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows of a string column in pieces of about `limit` bytes, one whole text at least.

    Yields first row, end row, bytes, and the offsets of the texts in these bytes.
    """
    if not len(column):
        return
    data, offsets = strings(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), len(column))
        own = offsets[first : end + 1]
        yield first, end, data[own[0] : own[-1]], own - own[0]
        first = end


def word_spans(
    data: np.ndarray, offsets: np.ndarray, word_class: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and per text the position of its first word.

    The third array has one entry more than there are texts.
    """
    inside = word_class[data]
    begins, ends = inside.copy(), inside.copy()
    if len(data):
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = offsets[:-1][offsets[1:] > offsets[:-1]]
        begins[full] = inside[full]
        last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
        ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(codes: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes."""
    codes = codes ^ (codes >> np.uint64(32))
    codes = codes * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    codes *= np.uint64(0xD6E8FEB86659FD93)
    return codes ^ (codes >> np.uint64(32))


class WordCoder:
    """64-bit codes of words, equal for words that differ in the case of A-Z only.

    A code is a polynomial in the word's bytes modulo 2**64; differences of running sums give
    it for all words of a block at once.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.letters = np.random.default_rng(20240229).integers(
            1, 2**63, size=256, dtype=np.uint64
        )
        self.letters[ord("A") : ord("Z") + 1] = self.letters[ord("a") : ord("z") + 1]
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, size: int) -> None:
        if size > len(self.powers):
            for name, base in (("powers", self.BASE), ("inverse", pow(self.BASE, -1, 2**64))):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])

    def text(self, words: list[bytes]) -> np.ndarray:
        """Codes of single words."""
        data = np.frombuffer(b" ".join(words), dtype=np.uint8)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        return self.codes(data, ends - lengths, ends) if words else np.empty(0, np.uint64)
