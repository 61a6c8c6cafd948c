"""Streams that keep a value for each key: only keys that changed are written, each batch once.

Targets are folders of ``buckets``: a batch merges its keys into the buckets that hold them and commits the manifest with its number, so a batch that is run again
after a failure finds its number there and does nothing. Readers see whole batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import buckets, usage

ROLLUP = "id string, day date, user_id {user}, tool string, calls long, errors long"
WINDOWS = "id string, day date, tool string, calls long"
MINUTE_MS, DAY_MS = 60_000, 86_400_000


def _named(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``id``, its keys as one text."""
    return df.select(F.to_json(F.struct(*keys)).alias("id"), "*")


def _done(spark: SparkSession, target: str, batch_id: int) -> bool:
    return buckets.note(spark, target).get("batch", -1) >= batch_id


def _added(spark: SparkSession, target: str, name: str, more: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """Rows of ``more`` with what the table has under their ids added."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in more.schema)
    old = buckets.table(spark, target, name, schema=schema).select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in sums))
    joined = more.join(old, F.col("id") == F.col("_id"), "left")
    return joined.select(*((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).cast("long").alias(c) if c in sums else F.col(c) for c in more.columns))


def rollup_stream(events: DataFrame, target: str, checkpoint: str):
    """Daily totals by (day, user_id, tool) of a stream of events, added to the table ``rollup`` of ``target``.

    There is no watermark: an event of any age reaches its day. State is the table itself, and a batch rewrites the buckets of its own keys.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _done(spark, target, batch_id):
            more = _named(usage.rollup(batch), "day", "user_id", "tool")
            rows = _added(spark, target, "rollup", more, ("calls", "errors"))
            buckets.change(spark, target, {"rollup": buckets.Change("id", rows)}, {"batch": batch_id})

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_rollup(spark: SparkSession, target: str) -> DataFrame:
    """(day, user_id, tool, calls, errors): one row a key."""
    return buckets.table(spark, target, "rollup", schema=ROLLUP.format(user="long")).drop("id")


def _micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def windows_stream(events: DataFrame, target: str, checkpoint: str, delay_days: float = 1.0):
    """Calls of each tool by windows of a UTC day, told once when the window closes, and beside them the late events, which no window counts any more.

    The watermark is the newest event of all batches before less ``delay_days``, as in append mode; it stands with the batch in the manifest. A window that ends at
    or before it is closed. An event is late if its window was closed when its batch began; it is added to ``late`` by (day, user_id, tool) instead. Open
    windows are all the state there is; closed, open and late together hold every event.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _done(spark, target, batch_id):
            return
        # an event's window ends with its UTC day
        day = F.floor(_micros("at") / (DAY_MS * 1000))
        rows = batch.where("at is not null").withColumn("_end", ((day + 1) * DAY_MS * 1000).cast("long"))
        before = buckets.note(spark, target).get("watermark")
        newest = rows.agg(F.max(_micros("at")).alias("t")).first().t
        after = before if newest is None else max(before or 0, int(newest - delay_days * DAY_MS * 1000))
        late = F.lit(False) if before is None else F.col("_end") <= F.lit(before)
        date = F.timestamp_micros(F.col("_end") - 1).cast("date")
        counted = _named(rows.where(~late).groupBy(date.alias("day"), "tool").agg(F.count("*").alias("calls")), "day", "tool")
        more = _added(spark, target, "open", counted, ("calls",))
        standing = buckets.table(spark, target, "open", schema=WINDOWS)
        standing = standing.join(more.select("id"), "id", "left_anti").unionByName(more)
        ended = F.lit(False) if after is None else (F.unix_date("day") + 1).cast("long") * DAY_MS * 1000 <= F.lit(after)
        closing = standing.where(ended)
        changes = {
            "open": buckets.Change("id", more.where(~ended), closing.select("id")),
            "closed": buckets.Change("id", closing),
            "late": buckets.Change("id", _added(spark, target, "late", _named(usage.rollup(rows.where(late)), "day", "user_id", "tool"), ("calls", "errors"))),
        }
        buckets.change(spark, target, changes, {"batch": batch_id, "watermark": after})

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_windows(spark: SparkSession, target: str, name: str = "closed") -> DataFrame:
    """(day, tool, calls) of closed or ``open`` windows; (day, user_id, tool, calls, errors) of ``late`` events."""
    return buckets.table(spark, target, name, schema=ROLLUP.format(user="long") if name == "late" else WINDOWS).drop("id")


def last_used_stream(events: DataFrame, target: str, checkpoint: str):
    """(user_id, last_used): the minute of each user's last event (user_id, at). A user is written again only for a later minute, and only changed users are.

    State is the table itself: a batch's users meet the buckets that hold them. A late event never moves a user back.
    """
    user = events.schema["user_id"].dataType.simpleString()
    minute = F.floor(_micros("at") / (MINUTE_MS * 1000)).cast("long")
    rows = events.where("user_id is not null and at is not null").select("user_id", minute.alias("minute"))

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not _done(spark, target, batch_id):
            new = batch.groupBy("user_id").agg(F.timestamp_micros(F.max("minute") * MINUTE_MS * 1000).alias("last_used"))
            old = buckets.table(spark, target, "last_used", schema=f"user_id {user}, last_used timestamp").withColumnRenamed("last_used", "_old")
            later = new.join(old, "user_id", "left").where("_old is null or last_used > _old").drop("_old")
            buckets.change(spark, target, {"last_used": buckets.Change("user_id", later)}, {"batch": batch_id})

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_last_used(spark: SparkSession, target: str) -> DataFrame:
    return buckets.table(spark, target, "last_used", schema="user_id long, last_used timestamp")
