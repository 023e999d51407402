"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadlens import session


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node, without loops."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
        F.col("a") != F.col("b")
    ).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Node and component (its smallest node) of every node that has an edge.

    `edges` has the columns a and b; rows with a null in either are no edges. Rounds of large
    and small stars hang every node closer to the smallest one it can reach, until nothing
    changes; each round is written to the shared folder, so lineage stays short and nothing
    of the graph comes to the driver but a count and a checksum.
    """
    now = session.materialise(_oriented(edges.dropna(subset=["a", "b"])), "edges")
    seen = _fingerprint(now)
    while seen[0]:
        both = now.union(now.select("b", "a")).toDF("a", "b")
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        lowest = session.materialise(lowest.withColumnRenamed("a", "node"), "edges")
        large = both.join(lowest, F.col("a") == F.col("node")).where(F.col("b") > F.col("a"))
        large = session.materialise(_oriented(large.select(F.col("b").alias("a"), F.col("low").alias("b"))), "edges")
        parent = large.groupBy("a").agg(F.min("b").alias("low"))
        parent = session.materialise(parent.withColumnRenamed("a", "node"), "edges")
        small = large.join(parent, F.col("a") == F.col("node")).select(
            F.col("b").alias("a"), F.col("low").alias("b")
        )
        now = session.materialise(_oriented(small.union(parent.select("node", "low"))), "edges")
        if (new := _fingerprint(now)) == seen:
            break
        seen = new
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
