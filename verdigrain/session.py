"""Session helpers that operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parent.parent)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table through Spark's own reader, so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed there."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session without it gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="verdigrain-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has written to yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, held: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: this cuts the lineage at stored files.

    Its path is added to `held`, for dropped_tables. Files that a lazy result still reads stay until the
    owner of the shared folder deletes it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if held is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no lazy result reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Narrow rows dealt over all partitions before costly work: a small file is one partition, whatever its rows make."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def dealt_by_range(df: DataFrame, *order, held: list[str] | None = None) -> DataFrame:
    """Rows with the number of their range (``_range``) in an order.

    Stored, so that everything that follows sees the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges", held)
