"""Word counting in three dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadlens.functions import text

def tokens(lines: DataFrame, line: str | Column, dialect: str) -> DataFrame:
    """One row per token, column `word`; works on batch and streaming frames.

    * ``words``: lower-case, non-word separators, no empty tokens,
    * ``spaces``: case kept, single spaces, inner empty tokens counted,
    * ``changelog``: lower-case, non-word separators, a leading empty token counted.
    """
    line = F.col(line) if isinstance(line, str) else line
    if dialect == "spaces":
        found = lines.select(text.space_tokens(line).alias("tokens"))
    elif dialect in ("words", "changelog"):
        # Split in a projection of its own: it is the expensive part and is read repeatedly.
        found = lines.select(F.split(F.lower(line), r"\W+").alias("tokens"))
        if dialect == "changelog":
            found = found.select(text.drop_trailing_empty(F.col("tokens")).alias("tokens"))
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    # The outer form keeps the planner from testing the array's size below the projection,
    # which would split every line twice.
    exploded = found.select(F.explode_outer("tokens").alias("word"))
    return exploded.filter("word <> ''" if dialect == "words" else "word IS NOT NULL")


def word_count(lines: DataFrame, line: str | Column, dialect: str) -> DataFrame:
    """Total count per word. Partial counts are merged before the shuffle, so that
    frequent words cost one row per task."""
    return tokens(lines, line, dialect).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
