"""Windows over event time that run the same on a table and on a stream (an extension; batch is the parity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, size: str, late: str = "1 day") -> DataFrame:
    """(start, event_type, n); on a stream, rows later than `late` are dropped and closed windows emitted."""
    e = events.withColumn("_ts", F.col("ts").cast("timestamp_ntz" if not events.isStreaming else "timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_ts", late)
    n = e.groupBy(F.window("_ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 day") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events without a longer gap."""
    e = events.withColumn("_ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_ts", late)
    n = e.groupBy(F.session_window("_ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there and stops; the checkpoint lets the next run go on from it."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
