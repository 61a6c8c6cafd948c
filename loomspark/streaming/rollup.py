"""Streams over the event log: additive rollup, windows, live feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import index, usage


def rollup_stream(events: DataFrame, target: str, checkpoint: str):
    """Adds each micro-batch's daily rollup under its batch id. Late events are never dropped, so there is no watermark; a batch that is run again overwrites its own part."""

    def add(batch: DataFrame, batch_id: int) -> None:
        usage.rollup(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """The sum of all batches."""
    return spark.read.parquet(target).groupBy("day", "user_id", "tool").agg(F.sum("calls").alias("calls"), F.sum("errors").alias("errors"))


def windowed(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The same by event-time windows of a day with bounded state; what comes after the watermark is left to the rollup above."""
    return events.withWatermark("at", delay).groupBy(F.window("at", "1 day"), "tool").agg(F.count("*").alias("calls"))


def live(events: DataFrame, since_id: int, asof_ts, n: int = 8) -> DataFrame:
    """The newest ``n`` of seven days, marked if newer than the last seen id."""
    rows = events.where(F.col("at") > asof_ts - F.expr("interval 7 days"))
    return rows.orderBy(F.desc("at"), F.desc("id")).limit(n).withColumn("fresh", F.col("id") > since_id)


def corpus_sync(docs: DataFrame, whole: Callable[[], DataFrame], state: str, checkpoint: str, embedder):
    """Brings the index at ``state`` up to date whenever the stream of document files has something new.

    ``docs`` is the file stream that wakes it; ``whole`` gives the corpus as it is then, as chunks (id, hash, embed_text).
    The stream's checkpoint moves only when a step has succeeded, so a failed one is tried again, and a step is idempotent.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        if batch.take(1):
            index.sync(whole(), state, embedder, f"batch {batch_id}")

    return docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_hits(events: DataFrame, points: DataFrame, areas=("backend", "frontend", "mac-motoru"), tool: str = "read_doc") -> DataFrame:
    """(id, at, key): map points (key, area, path) of the documents that events (id, at, tool, text) read. ``events`` may be a stream.

    An unknown area counts as the first; blank paths hit nothing.
    """
    whole = F.regexp_replace("text", r"^\.?/", "")
    at = T.split_area(T.norm_path(whole), list(areas), areas[0])
    rows = events.where((F.col("tool") == tool) & (F.trim("text") != "")).select("id", "at", at.alias("_"))
    rows = rows.select("id", "at", F.col("_.area").alias("area"), F.col("_.path").alias("path"))
    return rows.join(points.select("key", "area", "path"), ["area", "path"]).select("id", "at", "key")


def last_used(events: DataFrame) -> DataFrame:
    """Per user, the minute of the last event: refreshed once a minute at most."""
    return events.groupBy("user_id").agg(F.date_trunc("minute", F.max("at")).alias("last_used"))


def last_used_stream(events: DataFrame, target: str, checkpoint: str):
    """``last_used`` of a stream: one row of state for each user, rewritten whole when a batch has come."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return last_used(events).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact_rollup(spark: SparkSession, target: str, into: str) -> None:
    """The batches summed into one table below ``into``, to read instead of them."""
    read_rollup(spark, target).write.mode("overwrite").parquet(f"{into}/batch=0")
