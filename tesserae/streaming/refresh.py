"""Keeping the blob table current from a feed of files, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.hashing import blob_oid


def arrivals(feed: DataFrame, *, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first arrival of each blob (path, content, time) within the watermark."""
    rows = feed.withColumn("oid", blob_oid(F.col("content")))
    return rows.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["oid"])


def refresh(feed: DataFrame, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Append arrivals to a Parquet table; a batch that runs again writes the same blobs once.

    Blobs that earlier batches stored are left out by an anti join, so a feed that repeats
    itself after the watermark adds nothing.
    """

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        new = batch.dropDuplicates(["oid"])
        if there:
            new = new.join(spark.read.parquet(table).select("oid"), "oid", "left_anti")
        new.write.mode("append").parquet(table)

    return arrivals(feed, **options).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
