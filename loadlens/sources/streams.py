"""Unbounded text sources."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Where each kind of event stream starts reading when it has no checkpoint.
STARTING_OFFSETS = {
    "ads": "earliest",
    "words": "earliest",
    "traffic": "latest",
    "words-changelog": "latest",
}


def read_kafka(spark: SparkSession, servers: str, topic: str, kind: str, **options: str) -> DataFrame:
    """Kafka values as strings in `value`, with the record's `timestamp`.

    Needs the Kafka connector on the class path. Spark picks a fresh consumer group per query.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", STARTING_OFFSETS[kind])
    )
    return reader.options(**options).load().select(F.col("value").cast("string"), "timestamp")


def read_text_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of files arriving below `path`, in `value`."""
    return spark.readStream.options(**options).text(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile()


def read_table_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Parquet rows arriving at `path`, a folder or a single file; the schema is taken from
    what is there. The folder's own path must be free of glob characters."""
    path = path.rstrip("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema).options(**options)
    if not _is_file(spark, path):
        return reader.parquet(path)
    # A stream reads folders: a single file is its folder, filtered by name.
    folder, _, name = path.rpartition("/")
    literal = re.sub(r"([*?{}\[\]\\])", r"\\\1", name)
    return reader.option("pathGlobFilter", literal).parquet(folder or ".")
