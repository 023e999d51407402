"""URL filtering by association rules mined with FP-growth, matched through an inverted index.

Everything here is a DataFrame expression or Spark's own FP-growth.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens import session

# Fixed rules: host, path, verdict.
FIXED_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
BAD = "label:bad"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.002, 0.6, 1.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without `://`."""
    found = F.coalesce(url, F.lit("")).contains("://")
    rest = F.substring_index(F.coalesce(url, F.lit("")), "://", 1)
    rest = F.substr(F.coalesce(url, F.lit("")), F.length(rest) + 4)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return (
        F.when(found, F.translate(host, UPPER, LOWER)).otherwise(empty),
        F.when(found, path).otherwise(empty),
    )


def fixed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fixed rule that fits, written host and path, and its verdict; else null."""
    rules = sorted(FIXED_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = verdict = None
    for on_host, on_path, says in rules:
        fits = ((host == on_host) | host.endswith("." + on_host)) & path.startswith(on_path)
        name = F.lit(on_host + on_path)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, F.lit(says)) if verdict is None else verdict.when(fits, F.lit(says))
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host labels, parent domain, path segments, query keys.

    Digits stand as one `#`, so numbered pages share their tokens.
    """
    text = F.coalesce(url, F.lit(""))
    host, path = url_parts(text)
    general = F.regexp_replace(path, r"[0-9]+", "#")

    def tagged(tag: str, values: Column) -> Column:
        return F.transform(
            F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(tag), v)
        )

    labels = F.split(host, r"\.")
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda pair: F.substring_index(pair, "=", 1))
    return F.array_distinct(
        F.concat(
            tagged("scheme:", F.array(F.regexp_extract(text, r"^([A-Za-z]+)://", 1))),
            tagged("part:", labels),
            tagged("host:", F.array(host)),
            tagged("path:", F.split(general, "/")),
            tagged("key:", keys),
        )
    )


def mine_rules(
    urls: DataFrame,
    labels: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> DataFrame:
    """Token combinations that mean a bad page: rule, antecedent, index_token, confidence.

    `urls` has page_id and url, `labels` doc_id, quality and toxic; a page is bad if its
    document is of low quality or toxic. FP-growth runs over all labelled URLs; only rules of
    enough support, confidence and lift that conclude "bad" stay. Each rule is indexed under
    its rarest token. The rules are written to the shared folder, so their size is known.

    Pages without a label teach nothing, nor do null ids; without any label there is no rule.
    """
    spark = urls.sparkSession
    bad = F.max(
        F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") > 0, F.lit(False))
    )
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("bad"))
    rows = urls.join(known, "page_id").select(
        F.concat(
            F.transform(tokens(F.col("url")), lambda t: F.concat(F.lit("t:"), t)),
            F.array(F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit("label:good"))),
        ).alias("items")
    )
    rows = session.materialise(rows, "url-baskets")
    empty = spark.createDataFrame(
        [], "antecedent array<string>, consequent array<string>, confidence double, lift double"
    )
    mined = empty
    if not rows.isEmpty():
        growth = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence)
        mined = growth.fit(rows).associationRules.select(*empty.columns)
    strong = (
        mined.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= min_lift))
        .select(
            F.transform("antecedent", lambda t: F.substr(t, F.lit(3))).alias("antecedent"),
            "confidence",
        )
    )
    found = strong.select(
        F.array_join(F.array_sort("antecedent"), " ").alias("rule"), "antecedent", "confidence"
    )
    counts = rows.select(F.explode("items").alias("token")).groupBy("token").count()
    rarest = (
        found.select("rule", F.explode("antecedent").alias("token"))
        .join(counts.select(F.substr("token", F.lit(3)).alias("token"), "count"), "token")
        .groupBy("rule")
        .agg(F.min_by("token", F.struct("count", "token")).alias("index_token"))
    )
    return session.materialise(found.join(rarest, "rule"), "url-rules")


def bad_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct URLs on which some mined rule fits, with the best rule and its confidence.

    A URL looks only at the rules indexed under one of its own tokens; a rule fits if the URL
    has its whole antecedent.
    """
    distinct = urls.select("url").where(F.col("url").isNotNull()).distinct()
    posted = distinct.select("url", tokens(F.col("url")).alias("tokens")).select(
        "url", "tokens", F.explode("tokens").alias("index_token")
    )
    fits = F.size(F.array_except("antecedent", "tokens")) == 0
    return (
        posted.join(rules, "index_token")
        .where(fits)
        .groupBy("url")
        .agg(
            F.max("confidence").alias("confidence"),
            F.max_by("rule", F.struct("confidence", "rule")).alias("mined_rule"),
        )
    )


def judge_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined_rule of every page.

    A fixed rule decides where one fits, the longest first. Elsewhere a page is blocked if a
    mined rule fits its URL and allowed if none does. Null URLs and URLs without `://` have
    an empty host and path, no rule, and are allowed unless a mined rule fits. Repeated rows
    are judged each; an empty table gives no row; other columns are not read.
    """
    rows = pages.select("page_id", "url")
    blocked = bad_urls(rows, mine_rules(rows, labels)).withColumnRenamed("url", "bad_url")
    host, path = url_parts(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"))
    return (
        rows.join(blocked, F.col("url") == F.col("bad_url"), "left")
        .withColumn("host", host)
        .withColumn("path", path)
        .withColumn("rule", rule)
        .withColumn(
            "verdict",
            F.coalesce(
                verdict,
                F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")),
            ),
        )
        .select("page_id", "url", "host", "path", "rule", "verdict", "mined_rule", "confidence")
    )
