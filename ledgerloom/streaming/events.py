"""Windowed counts over a stream of events, and the same over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATENESS = "1 hour"


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by tumbling or sliding window and type; values summed as decimals, so in any order."""
    return events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total")
    ).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """One row for each run of a user's events without a pause of ``gap``."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n_events")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events"
    )


def stream(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """A streaming frame over event files in a folder, with a watermark."""
    schema = spark.read.option("pathGlobFilter", files).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def run_once(spark: SparkSession, path: str, checkpoint: str, name: str, files: str = "*") -> DataFrame:
    """Process what has arrived and return the windows so far, those still open included.

    Each batch writes the windows it changed beside the checkpoint, a repeated batch over its first
    try; the watermark drops the state of closed windows, and no row is held by the driver. Events of
    closed windows are late and not counted.
    """
    out = f"{checkpoint.rstrip('/')}-{name}"
    counted = windowed(stream(spark, path, files))

    def put(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    q = counted.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], counted.schema)  # nothing has arrived
    latest = F.max_by(F.struct("n_events", "total"), "batch").alias("last")
    return spark.read.parquet(out).groupBy("window_start", "event_type").agg(latest).select("window_start", "event_type", "last.*")
