"""Extensions for streams: alarm rates over event-time windows, a stream firewall, duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling_rates(events: DataFrame, time: str, score: str, threshold: float, every: str = "1 hour", late: str = "10 minutes", by: list[str] = ()) -> DataFrame:
    """window_start, by, rows, alarms, rate; on a stream, windows close once the watermark has passed them."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_t", late)
    out = rows.groupBy(F.window("_t", every), *by).agg(F.count("*").alias("rows"), F.count_if(F.col(score) >= threshold).alias("alarms"))
    return out.select(F.col("window.start").alias("window_start"), *by, "rows", "alarms", (F.col("alarms") / F.col("rows")).alias("rate"))


def sessions(events: DataFrame, time: str, key: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """key, session_start, session_end, events, total: events no further apart than the gap."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_t", late)
    out = rows.groupBy(F.session_window("_t", gap).alias("s"), key).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return out.select(key, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events", "total")


def clean_stream(stream: DataFrame, column: str, forbidden: DataFrame) -> DataFrame:
    """A stream without rows whose hash is in a static table."""
    keys = forbidden.select(F.lower("sha256").alias("_h")).distinct()
    joined = stream.withColumn("_k", F.lower(F.col(column))).join(keys, F.col("_k") == F.col("_h"), "left_outer")
    return joined.where("_h is null").drop("_k", "_h")


def first_seen(stream: DataFrame, content: str, time: str, late: str = "1 hour") -> DataFrame:
    """A stream (or table) with one row per content, within the watermark."""
    if not stream.isStreaming:
        return stream.dropDuplicates([content])
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([content])


def run_to_end(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, as a table in memory; for tests and small streams."""
    spark: SparkSession = df.sparkSession
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
