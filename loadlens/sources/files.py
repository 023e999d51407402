"""Delimited curves, wide metric files, id lists and road graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadlens.operators.scan import running
from loadlens.operators.telemetry import metrics_long

ADS_PER_CAMPAIGN = 10


def read_workload_curve(
    spark: SparkSession, path: str, sep: str = "|", header: bool = True
) -> DataFrame:
    """`second|count` file as `(timestamp, value)`."""
    return (
        spark.read.schema("timestamp bigint, value int")
        .option("sep", sep)
        .option("header", header)
        .option("enforceSchema", True)
        .csv(path)
    )


def write_curve(df: DataFrame, path: str, sep: str = "|") -> None:
    """Delimited text with a header, one file per partition."""
    df.write.option("sep", sep).option("header", True).csv(path)


def read_metric_csv(
    spark: SparkSession, path: str, metric: str, job: str, time: Column | None = None
) -> DataFrame:
    """Wide metric file (time column, then one column per pod) as long samples.

    The first column is taken by position: its header may carry a byte order mark. `time`
    turns its text, available as `Time`, into a timestamp.
    """
    raw = spark.read.option("header", True).csv(path)
    wide = raw.toDF("Time", *raw.columns[1:]).filter(F.col("Time").isNotNull())
    at = F.to_timestamp("Time") if time is None else time
    return metrics_long(wide, ["Time"], metric).select(
        F.lit(job).alias("job"), "pod", "metric", at.alias("ts"), "value"
    )


def write_metric(samples: DataFrame, metric: str, path: str) -> None:
    """Samples of one metric as delimited text."""
    samples.filter(F.col("metric") == metric).write.option("header", True).csv(path)


def _numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Non-empty lines of one file with their 0-based number in file order."""
    # The id grows with the split and the row in it; its upper bits name the split.
    lines = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    kept = lines.filter(F.col("value") != "").withColumn("file", F.lit(0))
    numbered = running(
        kept, ["file"], ["id"], F.shiftright("id", 33), {"pos": ("pos", F.lit(1))}
    )
    return numbered.select((F.col("pos") - 1).alias("i"), F.col("value").alias(name))


def load_ad_campaigns(
    spark: SparkSession, ads_path: str, campaigns_path: str, per_campaign: int = ADS_PER_CAMPAIGN
) -> DataFrame:
    """`(ad_id, campaign_id)`: each campaign owns the next `per_campaign` ads of the list."""
    ads = _numbered_lines(spark, ads_path, "ad_id")
    campaigns = _numbered_lines(spark, campaigns_path, "campaign_id")
    return campaign_of_position(ads, campaigns, per_campaign)


def campaign_of_position(ads: DataFrame, campaigns: DataFrame, per_campaign: int) -> DataFrame:
    owner = ads.withColumn("c", F.floor(F.col("i") / per_campaign)).drop("i")
    return owner.join(campaigns.withColumnRenamed("i", "c"), "c").select("ad_id", "campaign_id")


ROAD_GRAPH = (
    "nodes array<struct<id string, latitude double, longitude double>>, "
    "edges array<struct<source string, target string>>"
)


def graph_tables(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of graph documents."""
    nodes = graphs.select(F.explode("nodes").alias("n")).select("n.*")
    edges = graphs.select(F.explode("edges").alias("e")).select("e.*")
    return nodes, edges


def read_road_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of JSON graph files."""
    return graph_tables(spark.read.schema(ROAD_GRAPH).option("multiLine", True).json(path))
