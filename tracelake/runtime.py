"""Session set-up and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tracelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tuned for; conf overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tracelake-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def _own_folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "tracelake", spark.sparkContext.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return os.path.join(_own_folder(spark), uuid.uuid4().hex, name)


def clear(spark: SparkSession) -> None:
    """Delete what this application has written by cut() and scratch(); for its end, when no result is to be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation, and later
    reads prune columns and partitions as with any Parquet table.
    """
    path = scratch(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # with its schema, as a table without rows and with partitions has no file to take it from
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df, a scan or a map over one, in as many tasks as there are cores at least, for work that its bytes do not show.

    Only a small input, of fewer splits than cores, is moved. Behind a shuffle, asking for
    the number of splits would run it: there use tasks() in a repartition.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def tasks(df: DataFrame) -> int:
    """Partitions for a shuffle before costly work: as set, but no fewer than cores, and not to be coalesced."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
