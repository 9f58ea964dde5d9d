"""The event log as a stream: idempotent append, windows, sessions and bounded session memory."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", max_files: int = 50) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs what is there to its end and returns the rows of the sink."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{root}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number:09d}")  # the same batch again replaces itself

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = max(p["batchId"] for p in q.recentProgress) if q.recentProgress else 0
    return spark.read.schema(stream.schema).parquet(f"{root}/out/{last:09d}")


def deduplicated(events: DataFrame, keep: str = "3650 days") -> DataFrame:
    """One event for each (user, type, value), however long ago the first was, within the watermark."""
    return events.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["user_id", "event_type", "value"])


def windows(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.withWatermark("ts", "1 day").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.unix_timestamp("session_window.start").alias("start"), F.unix_timestamp("session_window.end").alias("end"), "user_id", "n")
