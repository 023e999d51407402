"""Byte-level pair encoding and decoding by recursive queries over token positions.

Every task holds a small database of its own. Words of its rows become rows (position, token),
which a recursive query joins with the merge table until no pair of any word has a merge left;
an ordered aggregation over token rows gives the bytes back.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Encoded chunks a worker remembers before it starts anew; results don't depend on it.
REMEMBERED = 500_000
# Characters of text, or tokens, that are taken through the database together.
ROUND_CHARS = 2 << 20
ROUND_TOKENS = 1 << 19
# Pieces of new words that one recursive query contracts, in bytes, and its rounds: it keeps
# the rows of all rounds, so what is not finished then goes on in a next query.
QUERY_BYTES = 1 << 19
QUERY_ROUNDS = 48
# Segments beyond so many bytes contract all places of their lowest pair in one round.
LONG = 64

# Pairs of neighbouring tokens that have a merge, with its rank, which is also its token.
_PAIRS = """
  pair AS (
    SELECT segment, pos, next_pos, merges.token AS rank
    FROM (
      SELECT segment, pos, token, lead(token) OVER places AS next_token,
        lead(pos) OVER places AS next_pos, lead(segment) OVER places AS next_segment
      FROM state WINDOW places AS (ORDER BY pos)
    ) AS s
    JOIN merges ON merges.a = s.token AND merges.b = s.next_token
    WHERE segment = next_segment
  )
"""

_LAST = """
SELECT segment, pos, token, round
FROM state
JOIN (SELECT segment, max(round) AS round FROM state GROUP BY segment) USING (segment, round)
"""

# The leftmost pair of the lowest rank in each segment, one pair a round.
LEFTMOST = f"""
WITH RECURSIVE state AS (
  SELECT 0 AS round, segment, pos, token FROM start
  UNION ALL (
    WITH {_PAIRS}, best AS (
      SELECT segment, min(rank::BIGINT << 32 | pos) AS place,
        arg_min(next_pos, rank::BIGINT << 32 | pos) AS swallowed
      FROM pair GROUP BY segment
    )
    SELECT round + 1, segment, pos,
      CASE WHEN pos = place & 4294967295 THEN (place >> 32)::INTEGER ELSE token END
    FROM state JOIN best USING (segment)
    WHERE pos <> swallowed AND round < $rounds
  )
)
{_LAST}
"""

# All places of the lowest rank in each segment, from the left; of touching places (a a a)
# every second one. Same tokens as LEFTMOST where `Vocabulary.ordered` holds.
ALL_PLACES = f"""
WITH RECURSIVE state AS (
  SELECT 0 AS round, segment, pos, token FROM start
  UNION ALL (
    WITH {_PAIRS}, best AS (
      SELECT segment, min(rank) AS rank FROM pair GROUP BY segment
    ), low AS (
      SELECT pos, next_pos, rank,
        lag(next_pos) OVER (ORDER BY pos) IS DISTINCT FROM pos AS fresh
      FROM pair JOIN best USING (segment, rank)
    ), run AS (
      SELECT *, sum(fresh::INTEGER) OVER (ORDER BY pos) AS run FROM low
    ), taken AS (
      SELECT pos, next_pos, rank FROM run
      QUALIFY row_number() OVER (PARTITION BY run ORDER BY pos) % 2 = 1
    )
    SELECT round + 1, s.segment, s.pos, coalesce(taken.rank, s.token)
    FROM state AS s SEMI JOIN best ON best.segment = s.segment
    LEFT JOIN taken ON taken.pos = s.pos
    ANTI JOIN taken AS gone ON gone.next_pos = s.pos
    WHERE round < $rounds
  )
)
{_LAST}
"""

# Bytes stand as the characters of the same number.
DECODE = """
SELECT string_agg(bytes, '' ORDER BY pos) AS text FROM tokens JOIN vocabulary USING (token)
"""


def _in_order(token: bytes, ranks: dict[bytes, int]) -> bool:
    """Whether merges below the token's own rank leave just the two halves it is made of."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        found = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]
        at = min(range(len(found)), key=found.__getitem__)
        if found[at] >= ranks[token]:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return len(parts) <= 2


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by rank, all pairs of tokens that make another one, and byte pairs inside tokens."""

    tokens: list[bytes]
    merges: np.ndarray  # rows (a, b, a + b)
    joined: np.ndarray  # joined[x, y]: some token holds byte x before byte y
    ordered: bool  # every token is made by merges of rising rank

    @classmethod
    def read(cls, path: str | Path) -> Vocabulary:
        """A rank file: lines of a token in base64 and its rank, ranks from 0 on."""
        told = dict(map(bytes.split, Path(path).read_bytes().splitlines()))
        ranks = {base64.b64decode(token): int(rank) for token, rank in told.items()}
        merges = [
            (ranks[token[:i]], ranks[token[i:]], rank)
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        ]
        joined = np.zeros((256, 256), dtype=bool)
        for token in ranks:
            own = np.frombuffer(token, dtype=np.uint8)
            joined[own[:-1], own[1:]] = True
        return cls(
            sorted(ranks, key=ranks.__getitem__),
            np.array(merges, dtype=np.int32).reshape(-1, 3),
            joined,
            all(_in_order(token, ranks) for token in ranks if len(token) > 2),
        )

    def connect(self) -> duckdb.DuckDBPyConnection:
        """A database in memory that holds the two tables; it never writes to disk."""
        database = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        a, b, token = map(pa.array, np.ascontiguousarray(self.merges.T))
        merges = pa.table({"a": a, "b": b, "token": token})
        names = [t.decode("latin-1") for t in self.tokens]
        ids = pa.array(np.arange(len(names), dtype=np.int32))
        vocabulary = pa.table({"token": ids, "bytes": pa.array(names, pa.string())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary)):
            database.register("given", rows)
            database.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            database.unregister("given")
        return database


class Encoder:
    """Token ids of texts; chunks seen before are looked up.

    A space before a character that is no white space always begins a word of the pattern,
    so a text is cut there into chunks whose ids can be found alone. `pattern` must have that
    property, as the patterns of this family of vocabularies do.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary = vocabulary
        self.database = vocabulary.connect()
        self.words = regex.compile(pattern).findall
        self.no_cut = regex.compile(r" (?=\s|$)").search
        self.cut = regex.compile(r"(?<!^) (?=\S)").split
        ranks = {token: rank for rank, token in enumerate(vocabulary.tokens)}
        self.byte_tokens = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.known: dict[str, bytes] = {}  # ids of a chunk as int32

    def _fixpoint(self, query: str, start: pa.Table) -> list[pa.Table]:
        """Rows left when no pair has a merge, in tables that hold whole segments."""
        done = []
        while start.num_rows:
            self.database.register("start", start)
            left = self.database.sql(query, params={"rounds": QUERY_ROUNDS}).to_arrow_table()
            going = pc.equal(left["round"], QUERY_ROUNDS)
            done.append(left.filter(pc.invert(going)))
            start = left.filter(going).select(["segment", "pos", "token"])
        return done

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in order, and the number of ids of each word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        # No merge crosses the border of a word, nor a byte pair that no token holds.
        begins = np.ones(len(data), dtype=bool)
        begins[1:] = ~self.vocabulary.joined[data[:-1], data[1:]]
        begins[np.cumsum(sizes)[:-1]] = True
        segment = np.cumsum(begins, dtype=np.int32) - 1
        length = np.bincount(segment)[segment] if len(data) else segment
        start = pa.table(
            {
                "segment": segment,
                "pos": np.arange(len(data), dtype=np.int32),
                "token": self.byte_tokens[data],
            }
        )
        together = (length > LONG) & self.vocabulary.ordered
        done = [start.filter(pa.array(length == 1))]
        for query, chosen in ((LEFTMOST, ~together & (length > 1)), (ALL_PLACES, together)):
            done += self._fixpoint(query, start.filter(pa.array(chosen)))
        left = pa.concat_tables([t.select(["pos", "token"]) for t in done])
        pos, tokens = left["pos"].to_numpy(), left["token"].to_numpy()
        order = np.argsort(pos, kind="stable")
        ends = np.searchsorted(pos[order], np.cumsum(sizes))
        return tokens[order].astype(np.int32), np.diff(ends, prepend=0)

    def _word_ids(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct words, a bounded number of bytes at a time."""
        found: dict[str, bytes] = {}
        spelled = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in spelled])
        first = 0
        while first < len(words):
            reach = (ends[first - 1] if first else 0) + QUERY_BYTES
            last = max(int(np.searchsorted(ends, reach, side="right")), first + 1)
            ids, counts = self._contract(spelled[first:last])
            at = (np.concatenate([[0], np.cumsum(counts)]) * 4).tolist()
            raw = ids.tobytes()
            found.update(
                (word, raw[a:b]) for word, a, b in zip(words[first:last], at[:-1], at[1:])
            )
            first = last
        return found

    def _chunks(self, text: str) -> list[str]:
        """Chunks without the space before all but the first, which a space marks instead."""
        chunks = self.cut(text) if self.no_cut(text) else text.split(" ")
        chunks[0] = " " + chunks[0]
        return chunks

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks. Those that begin a section are cut one by one, all
        others as one text: a word begins where such a chunk does."""
        firsts = [c for c in chunks if c[:1] == " "]
        chunks = [c for c in chunks if c[:1] != " "]
        cut = [self.words(c[1:]) for c in firsts]
        words = self.words("".join([f" {c}" for c in chunks]))
        ids = self._word_ids(list(set(words).union(*cut)))
        for chunk, own in zip(firsts, cut):
            self.known[chunk] = b"".join(map(ids.__getitem__, own))
        raw = list(map(ids.__getitem__, words))
        last = np.searchsorted(
            np.cumsum(list(map(len, words))), np.cumsum([len(c) + 1 for c in chunks])
        )
        ends = (np.cumsum(list(map(len, raw)))[last] if chunks else last).tolist()
        data = b"".join(raw)
        self.known.update(zip(chunks, (data[a:b] for a, b in zip([0, *ends], ends))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as the bytes of an int32 array."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        cut = [self._chunks(text) for text in texts]
        self._learn(list(set().union(*cut).difference(self.known)))
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in cut]


class Decoder:
    """Bytes of token ids."""

    def __init__(
        self, vocabulary: Vocabulary, database: duckdb.DuckDBPyConnection | None = None
    ) -> None:
        self.database = database or vocabulary.connect()
        self.sizes = np.array([*map(len, vocabulary.tokens), 0], dtype=np.int64)

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """Bytes of every list of ids; tokens of many lists are strung together at a time, and
        cut by their lengths."""
        last = np.cumsum(ids.value_lengths().fill_null(0).to_numpy())
        tokens = pc.fill_null(ids.flatten(), -1).to_numpy()
        known = (tokens >= 0) & (tokens < len(self.sizes) - 1)
        upto = np.cumsum(np.append(0, self.sizes[np.where(known, tokens, -1)]))
        strung = []
        for first in range(0, len(tokens), ROUND_TOKENS):
            some = tokens[first : first + ROUND_TOKENS]
            pos = np.arange(len(some), dtype=np.int32)
            self.database.register("tokens", pa.table({"pos": pos, "token": some}))
            strung.append(self.database.execute(DECODE).fetchall()[0][0] or "")
        data = "".join(strung).encode("latin-1")
        ends = upto[last]
        return [data[a:b] for a, b in zip(np.append(0, ends[:-1]), ends)]


def _rounds(texts: list[str]) -> Iterator[list[str]]:
    """Texts in groups of about ROUND_CHARS characters."""
    waiting: list[str] = []
    chars = 0
    for text in texts:
        waiting.append(text)
        chars += len(text)
        if chars >= ROUND_CHARS:
            yield waiting
            waiting, chars = [], 0
    if waiting:
        yield waiting


IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))
BYTES = T.StructField("bytes", T.BinaryType())


def _schema(frame: DataFrame, keep: list[str], *added: T.StructField) -> T.StructType:
    fields = {f.name: f for f in frame.schema}
    return T.StructType([*(fields[c] for c in keep), *added])


def encode(
    documents: DataFrame, ranks: str | Path, pattern: str, keep: list[str], *, text: str = "text",
    back: bool = False,
) -> DataFrame:
    """Add `ids`, the token ids of every whole text, as an array of ints.

    `ranks` is a rank file, read on the driver; its content has a fixed size and is broadcast.
    Each match of `pattern` is encoded for itself: starting from bytes, its leftmost pair of
    the lowest rank is contracted until none has a rank. No special tokens.

    Null and empty texts have no ids. Each row is encoded for itself, so repeated rows have
    the same ids; an empty table gives an empty table. Returns the columns `keep` and `ids`,
    which replaces an input column of that name. With `back` the ids are decoded in the same
    pass, into `bytes`, as `decode` does.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(Vocabulary.read(ranks))
    added = [IDS, BYTES] if back else [IDS]
    keep = [c for c in keep if c not in [f.name for f in added]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, pattern)
        decoder = Decoder(vocabulary.value, encoder.database) if back else None
        for batch in batches:
            first = 0
            for texts in _rounds(batch.column(text).fill_null("").to_pylist()):
                raw = encoder.encode(texts)
                offsets = np.cumsum([0, *map(len, raw)]) // 4
                ids = pa.ListArray.from_arrays(
                    offsets.astype(np.int32), np.frombuffer(b"".join(raw), dtype=np.int32)
                )
                own = batch.slice(first, len(texts))
                first += len(texts)
                made = [ids, pa.array(decoder.decode(ids), pa.binary())] if decoder else [ids]
                yield pa.RecordBatch.from_arrays(
                    [*(own.column(c) for c in keep), *made], names=[*keep, *(f.name for f in added)]
                )

    schema = _schema(documents, keep, *added)
    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(
    encoded: DataFrame, ranks: str | Path, keep: list[str], *, ids: str = "ids"
) -> DataFrame:
    """Add `bytes`, what the ids of every row stand for, as binary.

    Null and empty lists give no bytes, nor do null ids and ids that the vocabulary hasn't.
    Returns the columns `keep` and `bytes`, which replaces an input column of that name.
    """
    vocabulary = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(ranks))
    keep = [c for c in keep if c != "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary.value)
        for batch in batches:
            found = pa.array(decoder.decode(batch.column(ids)), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), found], names=[*keep, "bytes"])

    schema = _schema(encoded, keep, BYTES)
    return encoded.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)
