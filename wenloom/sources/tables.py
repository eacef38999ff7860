"""Parquet tables of one data folder, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach; the session's own setting wins.

    Only where the setting is empty and the master local (tests) a temporary
    folder is made; a cluster without one is an error.
    """
    sc = spark.sparkContext
    told = spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY)
    if not told:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        told = tempfile.mkdtemp(prefix="wenloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(told)
    return told


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/wenloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, key: str) -> str:
    """Write ``df`` to the shared folder, a subfolder ``key=value`` for each value; the URI, for tasks that read single ones."""
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/wenloom-{uuid.uuid4().hex}")
    uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    df.write.partitionBy(key).parquet(uri)
    return uri


def release(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` has written and nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    root = checkpoint_dir(df.sparkSession).rstrip("/")
    for file in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("wenloom-") and path.getParent().toString().split(":")[-1].rstrip("/").endswith(root.split(":")[-1].lstrip("/")):
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            return


def spread(df: DataFrame, waves: int = 3) -> DataFrame:
    """Rebalance a scan that yields fewer partitions than ``waves`` per core.

    Large scans already have enough partitions and are left alone, so that
    nothing is shuffled at scale only to spread Python work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= waves * cores:
        return df
    return df.repartition(waves * cores)
