"""Session settings shared by batch and streaming jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every operator relies on. Shuffle partition counts are left to the
# cluster: AQE coalesces small ones and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

ARROW_BYTES = 4 << 20

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

# On a local disk a rename is one system call. The default manager goes through Hadoop's
# FileContext, which starts a process there for every link and permission that it looks at.
FILE_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"
LOCAL_FILE_MANAGER = (
    "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"
)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def small_arrow_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by size: ten thousand long texts, the default, are held several times
    over, in an executor's JVM, on the way and in the worker. Plans made later see this."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def build(app: str = "loadlens", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; `master=None` leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _on_local_disk(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file"


@contextmanager
def rocksdb_state(
    spark: SparkSession, partitions: int | None = None, checkpoint: str | None = None
) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, so that it may outgrow executor
    memory, and commit a batch as its changes; the session's own settings are put back.

    `partitions` is the number of state tasks of a batch, for queries whose batches are small:
    each costs a commit, whatever its rows. It stays with a query's checkpoint. A `checkpoint` on a
    local disk is written through `LOCAL_FILE_MANAGER`, unless the session names another one.
    """
    state = "spark.sql.streaming.stateStore"
    mine = {f"{state}.providerClass": ROCKSDB_PROVIDER, f"{state}.rocksdb.changelogCheckpointing.enabled": "true"}
    if partitions:
        mine["spark.sql.shuffle.partitions"] = str(partitions)
    if checkpoint and spark.conf.get(FILE_MANAGER, None) is None and _on_local_disk(spark, checkpoint):
        mine[FILE_MANAGER] = LOCAL_FILE_MANAGER
    before = {key: spark.conf.get(key, None) for key in mine}
    for key, value in mine.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


_local_roots: dict[str, str] = {}


def _local_root(spark: SparkSession) -> str:
    """One temporary folder per local application, removed at exit."""
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="loadlens-")
        atexit.register(shutil.rmtree, _local_roots[app], ignore_errors=True)
    return _local_roots[app]


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`, visible to every executor.

    Only a local master may fall back to a machine-local temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root(spark)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a reduced table to the shared folder and go on from there.

    For inputs that several branches of a plan read: the source is scanned once, and a lost
    executor costs a re-read of files instead of the whole lineage.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
