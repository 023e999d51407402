"""Quality rules whose cutoffs keep the share of good documents they reject under control.

Everything here is a DataFrame expression: texts are measured inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loadlens import session

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
# Bits of the bitmap that picks labelled documents: for each label, and in all (64 MB).
BITS_PER_LABEL, MOST_BITS = 16, 1 << 29

RATIO_CUTOFFS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 1.0, 1.5]
# Each rule rejects documents whose value is above a cutoff. Cutoffs are tried from the last,
# which rejects least, to the first.
RULES: dict[str, list[float]] = {
    "symbols_per_word": RATIO_CUTOFFS,
    "marks_per_word": RATIO_CUTOFFS,
    "repeat_share": RATIO_CUTOFFS[:9],
    "dup_lines_per_line": RATIO_CUTOFFS[:10],
    "word_length": [8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
}


@dataclass(frozen=True)
class Risk:
    """What calibration guarantees: in every stratum at once, with probability of at least
    1 - `delta`, each rule rejects at most the share `alpha` of good documents."""

    alpha: float = 0.005
    delta: float = 0.05


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """`fn(value)`, with `value` computed once however often `fn` uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def repeated_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words inside windows of `window` words that occur twice or more, the first included."""

    def covered(places: Column) -> Column:
        # Sorted starts of repeated windows: each adds what the one before doesn't cover.
        return F.aggregate(
            places,
            F.struct(F.lit(-window).alias("before"), F.lit(0).cast("long").alias("sum")),
            lambda a, p: F.struct(
                p.alias("before"), (a["sum"] + F.least(F.lit(window), p - a["before"])).alias("sum")
            ),
            lambda a: a["sum"],
        )

    def count(codes: Column) -> Column:
        pairs = F.sort_array(F.transform(codes, lambda c, i: F.struct(c.alias("c"), i.alias("i"))))
        repeated = let(
            pairs,
            lambda s: F.filter(
                s,
                lambda x, k: (F.get(s, k - 1)["c"] == x["c"]) | (F.get(s, k + 1)["c"] == x["c"]),
            ),
        )
        return covered(F.sort_array(F.transform(repeated, lambda x: x["i"])))

    def windows(words: Column) -> Column:
        return let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - window),
                lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))),
            ),
        )

    return F.when(
        F.size(words) > window,
        let(
            windows(words),
            lambda c: F.when(F.size(F.array_distinct(c)) < F.size(c), count(c)).otherwise(0),
        ),
    ).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """Struct of counts over a whole text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))

    def line_counts(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    lines = let(
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD)),
        line_counts,
    )
    words = let(
        F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")
        ),
    )
    return F.struct(
        words.alias("words"),
        lines.alias("lines"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?]")).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    """The fixed rules: too few words, or too many of them in repeated windows."""
    n, repeated = F.col("m.words.n_words"), F.col("m.words.n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * n)


def rule_values() -> dict[str, Column]:
    """Value of every rule; a text without words has 0."""
    n, lines = F.col("m.words.n_words"), F.col("m.lines.n_lines")
    counts = {
        "symbols_per_word": (F.col("m.n_symbols"), n),
        "marks_per_word": (F.col("m.n_marks"), n),
        "repeat_share": (F.col("m.words.n_repeat_words"), n),
        "dup_lines_per_line": (F.col("m.lines.n_dup_lines"), lines),
        "word_length": (F.col("m.word_chars"), n),
    }
    return {
        rule: F.when(total > 0, count / total).otherwise(F.lit(0.0))
        for rule, (count, total) in counts.items()
    }


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n draws with probability p, summed exactly in logarithms.

    Only asked for k below n * p, which bounds the number of terms; 1 for larger k.
    """
    odds = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(first.alias("term"), F.lit(float("-inf")).alias("sum")),
        lambda a, i: F.struct(
            (a["term"] + F.log((n - i) / (i + 1)) + F.log(odds)).alias("term"),
            F.when(a["sum"] == float("-inf"), a["term"])
            .otherwise(
                F.greatest(a["sum"], a["term"])
                + F.log1p(F.exp(-F.abs(a["sum"] - a["term"])))
            )
            .alias("sum"),
        ),
        lambda a: F.exp(a["sum"]),
    )
    return F.when((k < n * p) & (k < n), total).otherwise(F.lit(1.0))


def calibrate(measured: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """Cutoffs by stratum: columns stratum and cutoffs (a map of rules to cutoffs).

    `measured` has doc_id, stratum and `m` (see `measures`), `labels` doc_id and quality (1
    good, 0 bad). For every stratum and rule the cutoffs form a fixed sequence from lenient
    to strict; each is tested by the exact probability of seeing so few rejected good
    documents if the true share were `alpha`, and the sequence ends at the first failure.
    `delta` is divided by the number of strata and rules, so all guarantees hold together.
    Of the certified cutoffs the one that rejects the largest share of bad documents beyond
    its share of good ones is taken, the most lenient of equals; a rule that rejects no bad
    document is left out.

    A document with several labels is bad if one says so; null ids, null qualities and
    labels of other documents count nowhere. Null is a stratum of its own. Strata without
    enough labels, and empty tables, give no cutoffs.
    """
    risk = risk or Risk()
    one = labels.where(F.col("quality").isNotNull()).groupBy("doc_id")
    known = one.agg((F.min("quality") > 0).alias("good"))
    names = list(RULES)
    values = rule_values()
    rows = measured.select(
        "doc_id",
        "stratum",
        F.array(
            *(
                F.struct(
                    F.lit(name).alias("rule"),
                    # How many of the rule's cutoffs the document is above.
                    sum((values[name] > c).cast("int") for c in RULES[name]).alias("above"),
                )
                for name in names
            )
        ).alias("values"),
    )
    counts = (
        rows.join(known, "doc_id")
        .select("stratum", "good", F.inline("values"))
        .groupBy("stratum", "rule", "above")
        .agg(
            F.count_if("good").alias("good"),
            F.count_if(~F.col("good")).alias("bad"),
        )
    )
    counts = session.materialise(counts, "quality-counts")
    per_rule = W.partitionBy("stratum", "rule")
    steps = F.create_map(
        *(x for name in names for x in (F.lit(name), F.array(*map(F.lit, RULES[name]))))
    )
    totals = counts.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad")
    )
    # A cutoff of rank r rejects the documents that are above at least r cutoffs.
    grid = totals.select(
        "*", F.posexplode(F.element_at(steps, F.col("rule"))).alias("place", "cutoff")
    ).withColumn("rank", F.col("place") + 1)
    rejected = (
        grid.alias("g")
        .join(
            counts.select("stratum", "rule", "above", "good", "bad").alias("c"),
            F.col("g.stratum").eqNullSafe(F.col("c.stratum"))
            & (F.col("g.rule") == F.col("c.rule"))
            & (F.col("c.above") >= F.col("g.rank")),
            "left",
        )
        .groupBy("g.stratum", "g.rule", "g.rank", "g.cutoff", "g.n_good", "g.n_bad")
        .agg(
            F.coalesce(F.sum("c.good"), F.lit(0)).alias("good"),
            F.coalesce(F.sum("c.bad"), F.lit(0)).alias("bad"),
        )
    )
    tests = max(1, counts.select("stratum").distinct().count()) * len(names)
    tested = rejected.withColumn(
        "certified",
        binomial_tail(F.col("good"), F.col("n_good"), risk.alpha) <= risk.delta / tests,
    )
    strict = per_rule.orderBy(F.desc("rank")).rowsBetween(W.unboundedPreceding, 0)
    gain = F.try_divide("bad", "n_bad") - F.try_divide("good", "n_good")
    chosen = (
        tested.withColumn("certified", F.min("certified").over(strict))
        .where(F.col("certified") & (F.col("bad") > 0) & (gain > 0))
        .groupBy("stratum", "rule")
        .agg(F.max_by("cutoff", F.struct(gain, F.col("rank"))).alias("cutoff"))
    )
    cutoffs = chosen.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")
    )
    return session.materialise(cutoffs, "quality-cutoffs")


def verdicts(measured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add base_failed, kept and the names of the rules that reject (`rejected_by`).

    Rows without a cutoff for their stratum are judged by the fixed rules alone.
    """
    limits = cutoffs.select(F.col("stratum").alias("limits_of"), "cutoffs")
    joined = measured.join(limits, F.col("stratum").eqNullSafe(F.col("limits_of")), "left")
    breaches = [
        F.when(value > F.col("cutoffs")[rule], F.lit(rule)) for rule, value in rule_values().items()
    ]
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("rejected_by", F.array_compact(F.array(*breaches)))
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("limits_of", "cutoffs")
    )


def measure(documents: DataFrame) -> DataFrame:
    """doc_id, stratum (the language) and measures of every document."""
    return documents.select("doc_id", F.col("lang").alias("stratum"), measures(F.col("text")).alias("m"))


def judge(documents: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """Verdict on every document, without texts: doc_id, the counts, base_failed, kept.

    Texts are measured once; the counts are written to the shared folder, calibrated against
    the labels there and judged. Null texts measure as empty ones and fail the fixed rules;
    repeated rows are judged each; empty tables give no row; other columns are not read.
    """
    measured = session.materialise(measure(documents), "quality-measures")
    judged = verdicts(measured, calibrate(measured, labels, risk))
    return judged.select(
        "doc_id",
        F.col("m.words.n_words").alias("n_words"),
        F.col("m.word_chars").alias("word_chars"),
        F.col("m.n_symbols").alias("n_symbols"),
        F.col("m.lines.n_dup_lines").alias("n_dup_lines"),
        F.col("m.words.n_repeat_words").alias("n_repeat_words"),
        "base_failed",
        "kept",
        "rejected_by",
    )


def maybe_labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang and text of every labelled document, and of a few others; no text is shuffled.

    Ids are hashed to the places of a bitmap, which is broadcast in pieces of 4 KB. With 16 bits
    a label, 6 % of the other documents share a place with a label; with more labels than the
    largest bitmap has room for, more do. None is missed: only who comes along is left to chance.
    """
    known = labels.where("doc_id is not null and quality is not null").select("doc_id")
    bits = min(max(1, known.count()) * BITS_PER_LABEL, MOST_BITS)
    alike = documents.schema["doc_id"].dataType == labels.schema["doc_id"].dataType
    number = F.col("doc_id") if alike else F.col("doc_id").cast("double")
    place = F.pmod(F.xxhash64(number), F.lit(bits).cast("long"))
    piece, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place).cast("int")
    pieces = known.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(at.cast("long")).alias("bitmap"))
    pieces = session.materialise(pieces, "labelled-bits")
    rows = documents.select("doc_id", "lang", "text", piece.alias("in_piece"), at.alias("at"))
    byte = F.conv(F.hex(F.substring("bitmap", F.shiftright("at", 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(pieces), F.col("in_piece") == F.col("piece"))
    return met.where(F.getbit(byte, F.col("at") % 8) == 1).select("doc_id", "lang", "text")


def keep_good(documents: DataFrame, labels: DataFrame, risk: Risk | None = None) -> DataFrame:
    """Documents that `judge` keeps, with their own columns, under any names.

    Labelled documents and a few others are measured for the cutoffs, for which the labelled ones
    count; then every text is measured once, on its way to the verdict.
    """
    measured = session.materialise(measure(maybe_labelled(documents, labels)), "quality-measures")
    cutoffs = calibrate(measured, labels, risk)
    row = documents.select(F.struct("*").alias("row"), F.col("lang").alias("stratum"), "text")
    # Rows are numbered beside the measures: so conditions on these are not pushed below this
    # step, where each would measure the text again.
    number = F.monotonically_increasing_id().alias("at")
    measured = row.select("row", "stratum", measures(F.col("text")).alias("m"), number)
    return verdicts(measured, cutoffs).where("kept and at >= 0").select("row.*")
