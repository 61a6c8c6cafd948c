"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.memory import trim
from loomspark.sources.scratch import folder as shared_dir  # noqa: F401
from loomspark.sources.scratch import written as materialize

#: The six ASCII white-space characters: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32())}


#: Worker processes outlive stages; what operators keep in them for a stage is released by these when the next one begins.
RELEASED: list[Callable[[], None]] = []
_last_stage: list[int | None] = [None]


#: Rows of an Arrow batch that Python holds as lists at once.
MOST_ROWS = 2000


def release_old() -> None:
    """Called in a task: frees what the last stage's operators kept in this worker, once a stage."""
    stage = TaskContext.get().stageId()
    if _last_stage[0] != stage:
        for release in RELEASED:
            release()
        trim()
        _last_stage[0] = stage


def map_columns(df: DataFrame, carry: list[str], use: list[str], made: dict[str, str], fn: Callable) -> DataFrame:
    """Append columns that Python computes from whole Arrow batches.

    ``carry`` columns pass through untouched (nulls and all); ``fn`` gets the ``use`` columns as lists and returns the
    ``made`` columns (name: type) in order.
    """
    wide = df.select(*dict.fromkeys([*carry, *use]))
    schema = ", ".join([f"{c} {wide.schema[c].dataType.simpleString()}" for c in carry] + [f"{c} {t}" for c, t in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_old()
        for b in (whole.slice(at, MOST_ROWS) for whole in batches for at in range(0, max(1, len(whole)), MOST_ROWS)):
            new = fn(*(b.column(c).to_pylist() for c in use))
            arrays = [b.column(c) for c in carry] + [pa.array(v, ARROW[t]) for v, t in zip(new, made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *made])

    return wide.mapInArrow(run, schema)


#: Rows up to which a table, once counted, is broadcast.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its number of ``rows``, which has been counted, is small."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def join_named(rows: DataFrame, named: DataFrame, key: str, hot: DataFrame, carried: str, salts: int = 16) -> DataFrame:
    """``rows`` left-joined with ``named`` (one row for each ``key``); rows of a ``hot`` key are spread by salts of ``carried``.

    Only hot keys are copied for each salt. They are few, as each has many rows, and are broadcast if they are.
    """
    hot = materialize(hot.select(key).distinct())
    n = hot.count()
    if not n or n > SMALL_ROWS:
        return rows.join(named, key, "left")
    mark = F.broadcast(hot.withColumn("_hot", F.lit(True)))
    left = rows.join(mark, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(carried), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    right = named.join(mark, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0)))).drop("_hot")
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def n_words(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    ``edges`` has two long columns. Returns (node, root): every node of an edge with its component's smallest node.
    Each round is two joins on aggregated minima and ends in a written table, so lineage stays short; rounds go on
    until the edges no longer change.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(now)
    while last[0]:
        # large star: each node hands its larger neighbours to the smallest node around it
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(moved.unionByName(low.withColumnRenamed("m", "v")).distinct())
        if (mine := mark(now)) == last:
            break
        last = mine
    root = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
