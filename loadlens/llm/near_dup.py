"""Near-duplicate detection by MinHash with tensored banding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadlens import session
from loadlens.llm.batches import WordCoder, blocks, mix, spaced_words, word_spans
from loadlens.llm.components import components

# Rows up to which a table of ids is broadcast; longer ones are joined by shuffle.
BROADCAST_IDS = 2_000_000
# Shingles in a block of documents that is compared with other blocks. A block moves once for each
# of these: four times as many shingles make a sixteenth of the pairs and move a quarter as much.
BLOCK_SHINGLES = 1 << 18


@dataclass(frozen=True)
class Similarity:
    """What counts as near: `percent` of the union of two sets of `shingle`-word shingles.

    A pair at the limit s is missed by all tables with probability of at most
    2 * (1 - s**depth)**tables, 2.2e-5 as set here; for closer pairs it falls fast.
    """

    shingle: int = 3
    percent: int = 85
    tables: int = 12
    depth: int = 3


class Signer:
    """Shingle sets of texts, and the band halves of their MinHash signatures.

    There are two collections of `tables` halves; a half joins `depth` MinHash values into one
    code. Table (i, j) is keyed by half i of the first and half j of the second collection:
    2 * tables * depth MinHash values give tables**2 tables of keys 2 * depth deep.
    """

    def __init__(self, shingle: int, tables: int, depth: int) -> None:
        if tables > 128:
            raise ValueError("a half's place takes one byte")
        self.shingle, self.tables, self.depth = shingle, tables, depth
        rng = np.random.default_rng(97)
        count = 2 * tables * depth
        self.factors = rng.integers(0, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.masks = rng.integers(0, 2**63, size=count, dtype=np.uint64)
        self.coder, self.word_class = WordCoder(), spaced_words()

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle codes of all texts, and where each text's begin."""
        starts, ends, bounds = word_spans(data, offsets, self.word_class)
        words = self.coder.codes(data, starts, ends)
        k, counts = self.shingle, np.diff(bounds)
        sizes = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        long = np.repeat(counts >= k, sizes)
        at = np.arange(cuts[-1]) - np.repeat(cuts[:-1], sizes) + np.repeat(bounds[:-1], sizes)
        codes = np.zeros(cuts[-1], dtype=np.uint64)
        full = at[long]
        whole = np.zeros(len(full), dtype=np.uint64)
        for i in range(k):
            whole = mix(whole + words[full + i])
        codes[long] = whole
        for row in np.flatnonzero((counts > 0) & (counts < k)):  # the whole sequence as one
            code = np.full(1, int(counts[row]), dtype=np.uint64)
            for i in range(bounds[row], bounds[row + 1]):
                code = mix(code + words[i : i + 1])
            codes[cuts[row]] = code[0]
        for row in np.flatnonzero(sizes > 1):
            codes[cuts[row] : cuts[row + 1]].sort()
        fresh = np.ones(len(codes), dtype=bool)
        fresh[1:] = codes[1:] != codes[:-1]
        fresh[cuts[:-1][sizes > 0]] = True
        kept = np.concatenate([[0], np.cumsum(fresh)])
        return codes[fresh], kept[cuts]

    def halves(self, codes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """The 2 * tables half codes of every set that is not empty, one row each.

        The lowest byte of a code is the place of its half.
        """
        begins = cuts[:-1][np.diff(cuts) > 0]
        result = np.zeros((len(begins), 2 * self.tables), dtype=np.uint64)
        for place in range(2 * self.tables):
            half = np.full(len(begins), place, dtype=np.uint64)
            for one in range(place * self.depth, (place + 1) * self.depth):
                ranks = (codes ^ self.masks[one]) * self.factors[one]
                half = mix(half + np.minimum.reduceat(ranks, begins)) if len(begins) else half
            result[:, place] = (half << np.uint64(8)) | np.uint64(place)
        return result


def set_digest(codes: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(codes.tobytes(), digest_size=16).digest()


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("halves", T.ArrayType(T.LongType())),
    ]
)
SETS = T.StructType(
    [
        T.StructField("rep", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("shingles", T.BinaryType()),
    ]
)


def _sign(like: Similarity):
    """Worker function: size, digest and band halves of every text; a null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(like.shingle, like.tables, like.depth)
        for batch in batches:
            sizes, digests, halves = [], [], []
            for first, end, data, offsets in blocks(batch.column("text")):
                codes, cuts = signer.sets(data, offsets)
                own = np.diff(cuts)
                rows = iter(signer.halves(codes, cuts).view(np.int64))
                sizes += own.tolist()
                for k in range(end - first):
                    full = own[k] > 0
                    digests.append(set_digest(codes[cuts[k] : cuts[k + 1]]) if full else None)
                    halves.append(next(rows) if full else None)
            columns = [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                pa.array(halves, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=SIGNED.names)

    return run


def _write_sets(like: Similarity):
    """Worker function: digest and shingle codes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(like.shingle, like.tables, like.depth)
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column("text")):
                codes, cuts = signer.sets(data, offsets)
                own = [codes[cuts[k] : cuts[k + 1]] for k in range(end - first)]
                columns = [
                    batch.column("doc_id").slice(first, end - first),
                    pa.array([set_digest(c) for c in own], pa.binary()),
                    pa.array([c.tobytes() for c in own], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=SETS.names)

    return run


def _codes(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint64)


def _linked(percent: int, shared, left, right):
    return 100 * shared >= percent * (left + right - shared)


def _confirm(percent: int):
    """Worker function: of pairs with both sets, those that are near enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                a, b = _codes(left.as_buffer()), _codes(right.as_buffer())
                low, high = sorted((len(a), len(b)))
                if 100 * low < percent * high:
                    near.append(False)
                    continue
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                shared = int(np.count_nonzero(b[at] == a))
                near.append(_linked(percent, shared, len(a), len(b)))
            kept = batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))
            yield kept

    return run


def band_keys(reps: DataFrame, like: Similarity) -> DataFrame:
    """Table keys (key, rep): every pair of a first and a second half of a document.

    A document can meet another in table (i, j) only if both halves are shared, so halves
    that no other document has are left out before they are paired.
    """
    halves = reps.select("rep", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    shared = session.materialise(shared, "shared-halves")
    met = halves.join(shared, "half", "left_semi").groupBy("rep").agg(
        F.collect_list("half").alias("met")  # two times `tables` at most
    )

    def place(half: Column) -> Column:
        return half.bitwiseAND(F.lit(255))

    first = F.filter("met", lambda h: place(h) < like.tables)
    second = F.filter("met", lambda h: place(h) >= like.tables)
    pairs = met.select("rep", first.alias("first"), second.alias("second")).select(
        "rep", F.explode("first").alias("one"), "second"
    )
    pairs = pairs.select("rep", "one", F.explode("second").alias("two"))
    return pairs.select(F.xxhash64("one", "two").alias("key"), "rep")


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids and the like, marked for broadcast if it is short enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents whose full sets are near enough.

    Only sets that some pair needs move. `a` is the first member of a bucket, so fewer sets
    are an `a` than a `b`: those of `b` travel with their pair.
    """

    def needed(side: str, name: str) -> DataFrame:
        ids = session.materialise(pairs.select(F.col(side).alias("id")).distinct(), "pair-ids")
        own = sets.join(_small(ids), F.col("rep") == F.col("id"), "left_semi")
        return own.select(F.col("rep").alias(side), F.col("shingles").alias(name))

    both = pairs.join(needed("b", "right"), "b").join(needed("a", "left"), "a")
    return both.select("a", "b", "left", "right").mapInArrow(_confirm(percent), "a long, b long")


def _spread():
    """Worker function: a row for each shingle of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_codes(packed.as_buffer()) for packed in batch.column("shingles")]
            codes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            at = np.repeat(batch.column("at").to_numpy(), [len(own) for own in sets])
            columns = [pa.array(at, pa.int64()), pa.array(codes.view(np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["at", "shingle"])

    return run


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """The rarest shingles (shingle, rep, label) of each set, enough to meet every near set.

    `sets` has one number `at` and the size `n` of each. Two sets that are near enough share one
    of their first n - ceil(percent n) + 1 shingles in any order that both use; here rare ones
    come first, counted over all of `sets`. Those that no other set holds take the first places
    and meet nothing, so they have no row: a set with enough of its own has none at all.
    """
    every = sets.select("at", "shingles").mapInArrow(_spread(), "at long, shingle long").repartition("shingle")
    often = every.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = every.join(often.hint("shuffle_hash"), "shingle").groupBy("at").agg(
        F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("shared")
    )
    first = F.expr(f"int((n * {100 - percent}) div 100 + 1 - n + size(shared))")
    return (
        sets.select("at", "rep", "label", "n")
        .join(shared, "at")
        .where(first > 0)
        .select(F.explode(F.slice("shared", F.lit(1), first)).alias("one"), "rep", "label")
        .select("one.shingle", "rep", "label")
    )


def _shorten():
    """Worker function: size of each set, and the upper 32 bits of its codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_codes(packed.as_buffer()) for packed in batch.column("shingles")]
            short = [(codes >> np.uint64(32)).astype(np.uint32).tobytes() for codes in sets]
            columns = [
                batch.column("rep"),
                batch.column("label"),
                pa.array([len(codes) for codes in sets], pa.int64()),
                pa.array(short, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "label", "n", "short"])

    return run


def _compare_blocks(percent: int):
    """Worker function: documents of two blocks that bear different labels and may be near.

    Shingles with the same 32 bits count as shared, so no link is missed. `best` marks the
    pair of two labels whose sets seem to overlap most, one for each pair of blocks.
    """

    def table(members: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        reps = np.array([m["rep"] for m in members], dtype=np.int64)
        labels = np.array([m["label"] for m in members], dtype=np.int64)
        sizes = np.array([m["n"] for m in members], dtype=np.int64)
        return reps, labels, sizes, [np.frombuffer(m["short"], dtype=np.uint32) for m in members]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("left"), batch.column("right")):
                rep_a, label_a, sizes_a, sets_a = table(left.as_py())
                rep_b, label_b, sizes_b, sets_b = table(right.as_py())
                # Shingles of the left block by code, and the documents that hold each.
                held = np.concatenate(sets_a)
                owner = np.repeat(np.arange(len(sets_a)), sizes_a)
                order = np.argsort(held, kind="stable")
                held, owner = held[order], owner[order]
                found = []
                for k, codes in enumerate(sets_b):
                    low = np.searchsorted(held, codes, side="left")
                    runs = np.searchsorted(held, codes, side="right") - low
                    starts = np.repeat(low - np.cumsum(runs) + runs, runs)
                    shared = np.bincount(
                        owner[starts + np.arange(len(starts))], minlength=len(sets_a)
                    )
                    near = _linked(percent, shared, sizes_a, sizes_b[k]) & (label_a != label_b[k])
                    at = np.flatnonzero(near)
                    overlap = shared[at] / (sizes_a[at] + sizes_b[k] - shared[at])
                    b, of_b = np.full(len(at), rep_b[k]), np.full(len(at), label_b[k])
                    found.append((rep_a[at], b, label_a[at], of_b, overlap))
                a, b, of_a, of_b, overlap = (np.concatenate(x) for x in zip(*found))
                if not len(a):
                    continue
                low, high = np.minimum(of_a, of_b), np.maximum(of_a, of_b)
                order = np.lexsort((-overlap, high, low))
                best = np.ones(len(a), dtype=bool)
                best[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
                columns = [*(pa.array(x[order]) for x in (a, b, low, high)), pa.array(best)]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "low", "high", "best"])

    return run


def _left_over(
    keys: DataFrame, sets: DataFrame, labels: DataFrame, percent: int
) -> DataFrame | None:
    """Links between documents of one bucket that the bucket's first document didn't show.

    `labels` has rep and label, the component so far. Documents of buckets with several
    labels are grouped again by their rarest shingles (`_rarest`); groups with a single label are
    done.
    What is left is compared on 32 bits of each shingle, in blocks of similar set size, each
    pair of blocks once; a label that fills blocks has them to itself, so these don't meet each
    other. Pairs that may be near are confirmed on full sets, the best one of two labels first,
    the others where that one fails. Only links between different labels are looked for.
    """
    spark = keys.sparkSession
    labelled = keys.join(_small(labels), "rep")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    mixed = session.materialise(mixed.where("low < high").select("key"), "mixed-buckets")
    open_reps = keys.join(mixed, "key", "left_semi").select("rep").distinct()
    open_reps = session.materialise(open_reps.join(labels, "rep"), "open-documents")
    if open_reps.isEmpty():
        return None
    size = F.expr("octet_length(shingles) div 8")
    rows = sets.join(_small(open_reps), "rep").withColumns({"at": F.monotonically_increasing_id(), "n": size})
    rows = session.materialise(rows, "open-sets")
    rare = session.materialise(_rarest(rows, percent), "rare-shingles")
    groups = rare.groupBy("shingle").agg(
        F.min("rep").alias("first"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    groups = session.materialise(groups.where("low < high").select("shingle", "first"), "rare-groups")
    stars = rare.join(groups, "shingle").select(F.col("rep").alias("a"), F.col("first").alias("b"))
    clusters = session.materialise(components(stars), "clusters")
    if clusters.isEmpty():
        return None
    # Sets whose sizes are further apart than one class can't be near.
    width = -math.log(percent / 100)
    short = rows.select("rep", "label", "shingles").mapInArrow(
        _shorten(), "rep long, label long, n long, short binary"
    )
    member = short.join(_small(clusters), F.col("rep") == F.col("node")).select(
        "component", "rep", "label", "short", F.floor(F.log("n") / width).alias("class"), "n"
    )
    member = session.materialise(member, "cluster-members")
    # A cluster that fits one block needs no classes.
    totals = member.groupBy("component").agg((F.sum("n") <= BLOCK_SHINGLES).alias("fits"))
    totals = session.materialise(totals, "cluster-totals")
    member = member.join(_small(totals), "component").withColumn(
        "class", F.when(F.col("fits"), F.lit(0).cast("long")).otherwise(F.col("class"))
    )
    by_label = member.groupBy("component", "class", "label").agg(F.sum("n").alias("n"))
    by_label = session.materialise(by_label, "label-sizes")
    large = by_label.where(F.col("n") > BLOCK_SHINGLES).select(
        "component", "class", "label", F.ceil(F.col("n") / BLOCK_SHINGLES).cast("long").alias("own_parts")
    )
    sizes = by_label.where(F.col("n") <= BLOCK_SHINGLES).groupBy("component", "class").agg(
        F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("long").alias("parts")
    )
    large, sizes = session.materialise(large, "large-labels"), session.materialise(sizes, "cluster-sizes")
    own = F.col("own_parts").isNotNull()
    placed = (
        member.join(_small(large), ["component", "class", "label"], "left")
        .join(_small(sizes), ["component", "class"], "left")
        .select(
            "component",
            "class",
            F.when(own, F.col("label")).alias("of"),
            F.pmod(F.xxhash64("rep"), F.coalesce("own_parts", "parts")).alias("part"),
            F.struct("rep", "label", "n", "short").alias("one"),
        )
    )
    blocks_ = placed.groupBy("component", "class", "of", "part").agg(
        F.collect_list("one").alias("members"),  # about BLOCK_SHINGLES shingles
        F.min("one.label").alias("low"),
        F.max("one.label").alias("high"),
    )
    block = F.xxhash64("component", "class", F.struct("of"), "part")
    blocks_ = session.materialise(blocks_.withColumn("block", block), "cluster-blocks")
    slim = blocks_.select("block", "component", "class", "low", "high")
    left, right = slim.alias("l"), slim.alias("r")
    # Each block is compared with itself where it lies. Across blocks, each class meets itself
    # and the next one; the smaller block comes first within a class.
    own = blocks_.where("low < high").select(F.col("members").alias("left"), F.col("members").alias("right"))
    steps = left.withColumn("other", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    pairs = steps.join(
        right,
        (F.col("l.component") == F.col("r.component"))
        & (F.col("other") == F.col("r.class"))
        & ((F.col("l.class") < F.col("r.class")) | (F.col("l.block") < F.col("r.block"))),
    ).where((F.least("l.low", "r.low") < F.greatest("l.high", "r.high")))
    pairs = session.materialise(
        pairs.select(F.col("l.block").alias("x"), F.col("r.block").alias("y")), "block-pairs"
    )
    full = blocks_.select("block", "members")
    both = pairs.join(full.toDF("x", "left"), "x").join(full.toDF("y", "right"), "y")
    both = both.select("left", "right").union(own)
    near = both.mapInArrow(_compare_blocks(percent), "a long, b long, low long, high long, best boolean")
    near = session.materialise(near, "maybe-near")
    first = session.materialise(confirmed(near.where("best").select("a", "b"), sets, percent), "links")
    rest = near.where("not best")
    if rest.isEmpty():
        return first
    done = near.join(first, ["a", "b"], "left_semi").select("low", "high").distinct()
    rest = rest.join(done, ["low", "high"], "left_anti").select("a", "b")
    rest = session.materialise(rest, "unclear-pairs")
    return first if rest.isEmpty() else first.union(confirmed(rest, sets, percent))


def near_duplicates(documents: DataFrame, like: Similarity | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of `documents`.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a document's set holds
    its shingles of three words, or all its words as one if they are fewer. Documents are
    linked when their sets share 85 percent of their union, which is confirmed on the full
    sets; component_id is the smallest doc_id that can be reached, and the row with this
    doc_id is kept.

    Copies with equal sets become one class first, whatever their number. Classes meet in the
    tables of `band_keys`; each is compared with the first class of its bucket, so a bucket
    gives as many pairs as it has members. Where that leaves a bucket in several components,
    `_left_over` finds the links that are still missing.

    Null and empty texts and texts without words have an empty set, are linked with nothing
    and are kept. Rows that repeat a doc_id are judged each by its own text, but classes whose
    smallest doc_id is the same are one document. Rows without doc_id link nothing, have a
    null component_id, and are kept. An empty table gives no row; other columns are not read.
    """
    like = like or Similarity()
    session.small_arrow_batches(documents.sparkSession)
    signed = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sign(like), SIGNED)
    signed = session.materialise(signed, "signatures")
    known = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    reps = known.groupBy("digest").agg(
        F.min("doc_id").alias("rep"),
        F.first("halves").alias("halves"),
    )
    reps = session.materialise(reps, "classes")

    keys = session.materialise(band_keys(reps, like), "band-keys")
    centers = keys.groupBy("key").agg(F.min("rep").alias("center"), F.max("rep").alias("last"))
    centers = session.materialise(centers.where("center < last").select("key", "center"), "centers")
    keys = session.materialise(keys.join(centers, "key"), "buckets")
    stars = keys.select(F.col("center").alias("a"), F.col("rep").alias("b")).where("a < b").distinct()
    stars = session.materialise(stars, "stars")
    ids = session.materialise(keys.select(F.col("rep").alias("doc_id")).distinct(), "met-ids")
    texts = _apart(documents.select(F.col("doc_id").cast("long"), "text"), ids, "left_semi")
    sets = texts.mapInArrow(_write_sets(like), SETS)
    sets = session.materialise(sets.where(F.octet_length("shingles") > 0), "sets")
    again = sets.groupBy("rep", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not again.isEmpty():  # of rows that repeat an id, each set once
        sets = session.materialise(sets.dropDuplicates(["rep", "digest"]), "sets")
    # Sets that differ too much in size need no look.
    sizes = sets.groupBy("rep").agg(
        F.min(F.octet_length("shingles")).alias("least"), F.max(F.octet_length("shingles")).alias("most")
    )
    sizes = _small(session.materialise(sizes, "set-sizes"))
    alike = (100 * F.col("p.most") >= like.percent * F.col("q.least")) & (
        100 * F.col("q.most") >= like.percent * F.col("p.least")
    )
    stars = (
        stars.join(sizes.alias("p"), F.col("a") == F.col("p.rep"))
        .join(sizes.alias("q"), F.col("b") == F.col("q.rep"))
        .where(alike)
        .select("a", "b")
    )
    stars = session.materialise(stars, "stars-alike")

    links = session.materialise(confirmed(stars, sets, like.percent), "links")
    groups = session.materialise(components(links), "components")
    labels = ids.select(F.col("doc_id").alias("rep")).join(groups, F.col("rep") == F.col("node"), "left")
    labels = session.materialise(
        labels.select("rep", F.coalesce("component", "rep").alias("label")), "labels"
    )
    more = _left_over(keys.select("key", "rep"), sets, labels, like.percent)
    if more is not None:
        more = session.materialise(more, "links")
        if not more.isEmpty():
            groups = session.materialise(components(links.union(more)), "components")

    classes = reps.select("digest", "rep")
    rows = signed.select("doc_id", "n_shingles", "digest")
    rows = rows.join(classes, "digest", "left").join(groups, F.col("rep") == F.col("node"), "left")
    component = F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")
    )
    return rows.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(documents: DataFrame, like: Similarity | None = None) -> DataFrame:
    """One document of each class of `near_duplicates`, with its own columns under any names.

    Rows that repeat a doc_id with other texts are documents of their own: the text with the
    smallest SHA-256 goes by the id, the others by numbers that no id has, so that each is judged
    alone. Of rows with the same id and text one counts, the smallest by its columns in their
    order. Rows without doc_id stay, as do texts without words.
    """
    node = "node"
    while node in documents.columns:
        node = "_" + node
    number = F.col("doc_id").cast("long")
    again = documents.where(number.isNotNull()).groupBy(number.alias("doc_id")).count()
    again = session.materialise(again.where("count > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        numbered = documents.withColumn(node, number)
    else:
        rest = _apart(documents, again, "left_anti").withColumn(node, number)
        numbered = rest.unionByName(_number_texts(documents, again, node))
    judged = near_duplicates(numbered.select(F.col(node).alias("doc_id"), "text"), like)
    rejected = judged.where(~F.col("kept")).select("doc_id").distinct()
    rejected = session.materialise(rejected, "rejected")
    return _apart(numbered, rejected, "left_anti", node).drop(node)


def _number_texts(documents: DataFrame, again: DataFrame, node: str) -> DataFrame:
    """One row of each text of the ids in `again`, with a number of its own in `node`."""
    fields = [F.col(f"`{c}`") for c in documents.columns]
    order = [F.col(f"`{f.name}`") for f in documents.schema if not isinstance(f.dataType, T.MapType)]
    texts = _apart(documents, again, "left_semi").groupBy(
        F.col("doc_id").cast("long").alias("id"), F.sha2("text", 256).alias("digest")
    )
    texts = texts.agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("row"))
    texts = session.materialise(texts, "texts-of-ids")
    # A null text is the smallest.
    lead = texts.groupBy("id").agg(F.min(F.coalesce("digest", F.lit(""))).alias("lead"))
    texts = texts.join(lead, "id").withColumn("digest", F.coalesce("digest", F.lit("")))
    others = texts.where("digest <> lead").select("id", "digest").orderBy("id", "digest")
    low, high = documents.agg(*(f(F.col("doc_id").cast("long")) for f in (F.min, F.max))).first()
    numbers = others.rdd.zipWithIndex().map(lambda r: (*r[0], r[1]))
    numbers = documents.sparkSession.createDataFrame(numbers, "id long, digest string, at long")
    numbers = session.materialise(numbers, "numbers-of-texts")
    above = high < (1 << 62)  # else there may be no room above all ids
    number = F.lit(high + 1) + F.col("at") if above else F.lit(low - 1) - F.col("at")
    texts = texts.join(numbers, ["id", "digest"], "left")
    texts = texts.withColumn("number", F.coalesce(number, F.col("id")))
    return texts.select("row.*", F.col("number").alias(node))


def _apart(documents: DataFrame, ids: DataFrame, how: str, by: str = "doc_id") -> DataFrame:
    """Rows with or without an id in the written table `ids`, which is broadcast if small."""
    ids = ids.withColumnRenamed("doc_id", "id_of_row")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return documents.join(ids, F.col(by) == F.col("id_of_row"), how)
