"""Session defaults and the shared working folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
CODEC = "spark.sql.parquet.compression.codec"
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # a batch for a Python worker is bounded by its bytes: ten thousand rows of long texts are more than a worker should hold
    ARROW_BYTES: str(2 * 1024 * 1024),
    # indexes are written several times over, and disk runs out before time does
    CODEC: "zstd",
    # call-site capture costs a stack walk for every column expression built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "corvane", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; extra ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession, small_batches: bool = True) -> SparkSession:
    """Set on a given session the defaults that can still be changed there; operators that size their own blocks keep Spark's batches and files."""
    for key in ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy"):
        spark.conf.set(key, DEFAULTS[key])
    for key in (ARROW_BYTES, CODEC):
        if small_batches:
            spark.conf.set(key, DEFAULTS[key])
        else:
            spark.conf.unset(key)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, whose tasks run
    on one machine, may leave it unset: a temporary folder is then chosen and remembered.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def run_dir(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder for one run's tables."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def through_table(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back.

    Used where several consumers need the same expensive rows; the parquet
    copy keeps statistics, column pruning and push-down for each of them.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_table(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """The same for rows that are not needed after the block; their folder is deleted then."""
    spark, path = df.sparkSession, run_dir(df.sparkSession, label)
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
