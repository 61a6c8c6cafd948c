"""Keyed streams: several batches, restarts from the checkpoint, late events."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomspark.operators import buckets, usage
from loomspark.sources import manifest
from loomspark.streaming import keyed
from loomspark.streaming import rollup as streams

SCHEMA = "id long, at timestamp, user_id long, tool string, error string"
START = datetime(2024, 5, 10, 12)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def put(spark, folder, rows):
    """One more file of the stream."""
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def event(i, days=0.0, user=1, tool="read", error=None):
    return (i, START + timedelta(days=days), user, tool, error)


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_rollup_adds_to_what_changed(spark, tmp_path):
    src, target, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    batches = [[event(1), event(2, user=2, error="x"), event(3, tool="grep"), event(9, user=None)], [event(4, -100), event(5)], [event(6, -100, error="y")]]
    for n, rows in enumerate(batches):
        put(spark, src, rows)
        # each start goes on from the checkpoint
        keyed.rollup_stream(stream(spark, src), target, cp).awaitTermination()
        assert buckets.note(spark, target)["batch"] == n
    columns = ("day", "user_id", "tool", "calls", "errors")
    want = as_set(usage.rollup(spark.createDataFrame([r for b in batches for r in b], SCHEMA)).select(*columns))
    assert as_set(keyed.read_rollup(spark, target).select(*columns)) == want and len(want) == 4
    before, after = (manifest.read(spark, target, v)[1]["tables"]["rollup"]["buckets"] for v in (2, 3))
    assert sum(before.get(b) != at for b, at in after.items()) == 1


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    src, target = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, src, [event(1), event(2)])
    # the second run has lost its checkpoint, so the same batch comes again
    for cp in ("a", "b"):
        keyed.rollup_stream(stream(spark, src), target, f"{tmp_path}/{cp}").awaitTermination()
    assert [r.calls for r in keyed.read_rollup(spark, target).collect()] == [2]


def test_windows_and_late_events_lose_nothing(spark, tmp_path):
    src, target, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    batches = [
        [event(1, -3), event(2, -3, tool="grep"), event(3, 0)],
        # two days old at a watermark of one day: late; today's still counts
        [event(4, -3), event(5, 0), event(6, 0.2, user=2)],
        [event(7, 4)],
        [event(8, 0), event(9, 4)],
    ]
    native = []
    for rows in batches:
        put(spark, src, rows)
        windowed = streams.windowed(stream(spark, src), "1 day").select(F.to_date("window.start").alias("day"), "tool", "calls")
        keyed.windows_stream(stream(spark, src), target, cp).awaitTermination()
        told = windowed.writeStream.outputMode("append").foreachBatch(lambda df, i: native.extend(map(tuple, df.collect())))
        told.option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    closed, open_, late = (keyed.read_windows(spark, target, n) for n in ("closed", "open", "late"))
    day = lambda n: (START + timedelta(days=n)).date()
    assert as_set(closed) == {(day(-3), "read", 1), (day(-3), "grep", 1), (day(0), "read", 3)}
    assert as_set(open_) == {(day(4), "read", 2)}
    assert as_set(late.select("day", "user_id", "tool", "calls")) == {(day(-3), 1, "read", 1), (day(0), 1, "read", 1)}
    total = sum(df.agg(F.sum("calls")).first()[0] for df in (closed, open_, late))
    assert total == sum(map(len, batches))
    # the same as append mode's own windows, where a batch's windows close before the next comes
    assert set(native) == as_set(closed)


def test_last_used_writes_changed_users_only(spark, tmp_path):
    src, target, cp = (f"{tmp_path}/{n}" for n in ("in", "out", "cp"))
    told = lambda: {r.user_id: r.last_used for r in keyed.read_last_used(spark, target).collect()}
    put(spark, src, [event(i, user=i) for i in range(20)] + [event(50, user=None)])
    keyed.last_used_stream(stream(spark, src), target, cp).awaitTermination()
    assert told() == dict.fromkeys(range(20), START)
    # the same minute, an older event, and one later minute
    put(spark, src, [(21, START + timedelta(seconds=40), 3, "read", None), event(22, -5, user=4), (23, START + timedelta(minutes=7, seconds=5), 5, "read", None)])
    keyed.last_used_stream(stream(spark, src), target, cp).awaitTermination()
    assert told() == dict.fromkeys(range(20), START) | {5: START + timedelta(minutes=7)}
    before, after = (manifest.read(spark, target, v)[1]["tables"]["last_used"]["buckets"] for v in (1, 2))
    assert sum(before[b] != at for b, at in after.items()) == 1
