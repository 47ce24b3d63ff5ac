"""Incremental ingestion: each new record once, across restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import keep_one_delivery


def raw_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files below ``path`` as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).json(path)


def append_new(batch: DataFrame, target: str) -> None:
    """Append each id of ``batch`` once, if ``target`` doesn't have it, however
    far apart its copies come. Running a batch again adds nothing twice."""
    spark = batch.sparkSession
    new = keep_one_delivery(batch).select(*batch.columns)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_spark_metadata")):
        raise ValueError(f"{target} was written by a streaming sink; rewrite it as a plain table first")
    if fs.exists(path):
        new = new.join(spark.read.schema("id string").parquet(target).select("id"), "id", "left_anti").select(*batch.columns)
    new.write.mode("append").partitionBy("subreddit").parquet(target)


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append everything new to ``target`` (Parquet by community) and stop.

    The checkpoint holds what was read; a batch that runs again after a crash
    finds its ids in the table, so the table has every id once. Rows without
    an id are left out. One ingest may write to a target at a time.
    """
    raw = raw_stream(spark, source, schema)
    return raw.writeStream.foreachBatch(lambda batch, _: append_new(batch, target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Records per community and window of delivery, for monitoring."""
    timed = stream.withColumn("delivered", F.timestamp_seconds("retrieved_on")).withWatermark("delivered", late)
    return timed.groupBy(F.window("delivered", width), "subreddit").agg(F.count(F.lit(1)).alias("n_records"))
