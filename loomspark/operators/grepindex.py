"""Literal line search over a kept trigram index: candidates by their trigrams' intersection, then lines verified.

``build`` writes documents' lines (path, line, text), sorted by path, with numbers, and for each trigram of the folded text the numbers of the lines that hold it, by ``BUCKETS``
hash buckets of trigrams, a row for each batch of lines that was read together. ``grep`` reads the buckets of its needle's trigrams alone, counts for each line how many of
them it has, and verifies only lines that have them all; of the lines, only row groups whose numbers can match are read. Needles of fewer than three characters have no
trigram and are searched in all lines.

Rows are those of ``search.grep``: literal, without case (İ and I are i), numbered from 1, trimmed of spaces and cut to 300 characters, in path and line order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.sources.scratch import written

BUCKETS = 64
#: Candidate lines up to which their numbers are handed to the scan, after a count.
FEW = 10_000


def _bucket(gram: Column | str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _held(c: np.ndarray) -> np.ndarray:
    """The trigram that begins at each character, as a number of 21 bits a character; -1 where the line ends before the trigram does."""
    c = np.r_[c, 10, 10]
    ends = c == 10
    return np.where(ends[:-2] | ends[1:-1] | ends[2:], -1, c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, ns) of the lines (n, folded) of a batch: one list for each trigram, so no row is made for each trigram of a line."""
    for b in batches:
        c = _characters("\n".join(b.column("folded").to_pylist()))
        grams, line = _held(c), np.cumsum(c == 10)
        at = np.flatnonzero(grams >= 0)
        # lines are in the order of their numbers: a stable sort by trigram keeps them so
        at = at[np.argsort(grams[at], kind="stable")]
        grams, own = grams[at], np.asarray(b.column("n"), np.int64)[line[at]]
        fresh = np.r_[True, (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])][: len(grams)]
        grams, own = grams[fresh], own[fresh]
        begins = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]][: len(grams)])
        ns = pa.ListArray.from_arrays(pa.array(np.r_[begins, len(own)].astype(np.int32)), pa.array(own))
        yield pa.RecordBatch.from_arrays([pa.array(grams[begins]), ns], names=["gram", "ns"])


def build(docs: DataFrame, path: str) -> None:
    """Writes the index of documents (path, text) to ``path``; null texts have no lines."""
    spark = docs.sparkSession
    each = docs.where("text is not null and path is not null").select("path", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    each.repartitionByRange("path").sortWithinPartitions("path", "pos").write.mode("overwrite").parquet(f"{path}/raw")
    # numbers grow with path and line inside a file, so a file's row groups have ranges of their own
    raw = spark.read.schema(each.schema).parquet(f"{path}/raw")
    raw.select(F.monotonically_increasing_id().alias("n"), "path", (F.col("pos") + 1).cast("int").alias("line"), "raw").write.mode("overwrite").parquet(f"{path}/lines")
    lines = spark.read.parquet(f"{path}/lines")
    held = lines.select("n", T.fold(F.col("raw")).alias("folded")).mapInArrow(_lists, "gram long, ns array<long>")
    held.withColumn("bucket", _bucket("gram")).repartition(BUCKETS, "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/grams")


def candidates(spark: SparkSession, path: str, needle: str) -> DataFrame | None:
    """(n): lines with all trigrams of the needle; None if it has none."""
    folded = spark.range(1).select(T.fold(F.lit(needle)).alias("t")).first().t
    grams = sorted({int(g) for g in _held(_characters(folded)) if g >= 0})
    own = spark.range(1).select(F.explode(F.lit(grams).cast("array<long>")).alias("gram")).select("gram", _bucket("gram").alias("bucket")).collect() if grams else []
    if not own:
        return None
    held = spark.read.parquet(f"{path}/grams").where(F.col("bucket").isin(sorted({r.bucket for r in own})) & F.col("gram").isin(sorted(r.gram for r in own)))
    return held.select(F.explode("ns").alias("n")).groupBy("n").agg(F.count("*").alias("c")).where(F.col("c") == len(own)).select("n")


def grep(spark: SparkSession, path: str, needle: str, prefix: str = "", limit: int | None = 50) -> DataFrame:
    """(path, line, text) of the lines with the needle below a prefix; all of them, or the first ``limit``."""
    prefix = prefix[2:] if prefix.startswith("./") else prefix.removeprefix("/")
    lines = spark.read.parquet(f"{path}/lines")
    if (wanted := candidates(spark, path, needle)) is not None:
        wanted = written(wanted)
        few = [r.n for r in wanted.limit(FEW + 1).collect()]
        # a few numbers reach the scan and skip row groups; many are joined
        lines = lines.where(F.col("n").isin(few)) if len(few) <= FEW else lines.join(wanted, "n", "left_semi")
    hits = lines.where(F.col("path").startswith(prefix) & T.fold(F.col("raw")).contains(T.fold(F.lit(needle))))
    found = hits.select("path", "line", F.substring(F.trim("raw"), 1, 300).alias("text"))
    return found if limit is None else found.orderBy("path", "line").limit(limit)
