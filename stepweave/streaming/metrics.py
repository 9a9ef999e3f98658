"""Running metrics over arriving files, equal to the batch answer at the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.cluster import shared_dir
from stepweave.operators.metrics import EXACT, sane


def running(results: DataFrame) -> DataFrame:
    """Per method: rows, right ones, latency; works on a stream and on a table."""
    ms = sane(F.col("latency_ms")).cast(EXACT)
    return results.groupBy("method").agg(F.count("*").alias("n"), F.sum(F.coalesce("primary_correct", F.lit(False)).cast("int")).alias("n_right"), F.count(ms).alias("n_ms"), F.sum(ms).cast("double").alias("total_ms"))


def stream_files(spark: SparkSession, path: str, files_per_batch: int = 4, state: str | None = None) -> DataFrame:
    """All files of a folder (or one file's folder, by its name) as a stream of micro-batches, drained, its last state as a table.

    state: the folder of state and checkpoint; a query started again on it goes on where the
    last one stopped and reads only files that came since. Without one a new folder in the
    shared one, for a single run.
    """
    schema = spark.read.parquet(path).schema
    base = state or f"{shared_dir(spark).rstrip('/')}/stepweave-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        source, path = source.option("pathGlobFilter", place.getName()), place.getParent().toString()
    stream = source.parquet(path)

    def keep(batch: DataFrame, number: int) -> None:
        # a folder per batch: the state before stays readable while the next is written
        batch.write.mode("overwrite").parquet(f"{base}/state/{number}")

    query = running(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/state")
    files = home.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(home):
        return running(spark.createDataFrame([], schema))
    last = max(int(x.getPath().getName()) for x in files.listStatus(home))
    return spark.read.parquet(f"{base}/state/{last}")
