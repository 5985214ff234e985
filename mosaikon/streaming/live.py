"""Measurements as they come in: windows with a watermark, and stores that batches are merged into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """events(event_id, ts, user_id, event_type, value, props) as a stream: a folder's files as they come, or one file."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    reader, at = spark.readStream.schema(schema), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def window_means(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, mean for each window; rows later than the watermark are left out."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return got.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that is there now, as a table in memory: for results that are small, such as windows."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def accumulate(stream: DataFrame, path: str, checkpoint: str):
    """Sums of peaks(pixel_id, bin, v) per batch, appended to a store: readers add up the parts.

    A batch that is tried again writes its own folder again, so nothing counts twice.
    """
    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("bin").agg(F.sum("v").alias("s"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
