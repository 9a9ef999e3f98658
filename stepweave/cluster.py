"""Helpers that keep plans safe on a cluster: table reading, input spreading, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a directory of tables."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Rows of a scan over at least the cluster's cores before Python work that costs much per row.

    For scans only: with a shuffle in df's plan, counting partitions would run it. Only where the scan has fewer partitions than there are cores (a small table in one
    file); a large table has more splits than cores, and its rows stay where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * factor)
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own only where it is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="stepweave-"))
    return sc._jsc.sc().getCheckpointDir().get()


_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: later plans start from files that outlive any executor.

    The files stay, as the result may be read at any time; `clear` deletes those of the
    session when its results have been written.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stepweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that this session cut, and says how many; results that were not written or collected are lost."""
    n = len(_CUTS)
    while _CUTS:
        place = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return n


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df for a broadcast join if it has at most so many rows, else df itself for a shuffled one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
