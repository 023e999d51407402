"""Tokenisers that follow the JVM's `String.split` rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def space_tokens(line: Column) -> Column:
    """Split on single spaces; inner and leading empty tokens stay, trailing ones go.

    An empty line is one empty token; a line made of spaces only has no token at all.
    """
    trimmed = F.rtrim(line)
    return (
        F.when(line == "", F.array(F.lit("")))
        .when(trimmed == "", F.array().cast("array<string>"))
        .otherwise(F.split(trimmed, " "))
    )


def drop_trailing_empty(tokens: Column) -> Column:
    """Finish a split on separator runs: Spark keeps a trailing empty token, the JVM does not.

    Runs leave at most one empty token at either end; an empty line stays one empty token.
    """
    size = F.size(tokens)
    only_separators = (size == 2) & (F.get(tokens, F.lit(0)) == "")
    kept = F.when(only_separators, 0).otherwise(size - 1)
    return F.when(
        (size > 1) & (F.element_at(tokens, -1) == ""), F.slice(tokens, F.lit(1), kept)
    ).otherwise(tokens)
