"""Approximate nearest vectors by inverted lists that are kept: centres, residuals in bytes, probes tuned to a recall.

``build`` writes a folder: ``model`` (centres, and the range of residuals in each component) and ``lists``, in which every vector stands once, under its
nearest centre, as the bytes of its residual. ``tune`` finds out how many lists a query has to read: for some queries the true neighbours are found
by brute force, and the lists they are in are looked up in the query's order of centres; the share ``target`` of these places is the number of probes, which
``probes`` keeps. ``search`` reads the lists that its queries probe, ranks by the bytes, and scores the best again by the vectors.

Centres come from a sample of at most ``SAMPLE`` vectors and are at most ``MOST_LISTS``; lists of more than ``PART`` vectors are dealt out by hash. A query's work is
its share of lists, and that is what tuning finds: a few lists where vectors lie in groups, a steady share of all where they have no structure.

By cosine, as ``search.knn``: null vectors take no part, a zero vector scores 0. Equal scores go to the smaller key. An empty table has an empty index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators import search
from loomspark.sources.scratch import written

SAMPLE, MOST_LISTS, PART, LEVELS = 65_536, 4096, 8192, 255
#: Queries that tuning asks, the recall it aims at, and candidates scored again for each result asked for.
ASKED, TARGET, AGAIN = 256, 0.97, 4


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _order(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """Numbers of the nearest centres, nearest first."""
    distance = (centres**2).sum(1)[None] - 2 * x @ centres.T
    if most < len(centres):
        part = np.argpartition(distance, most - 1, axis=1)[:, :most]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(distance, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(distance, axis=1, kind="stable")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def build(vectors: DataFrame, path: str, lists: int | None = None, seed: int = 7) -> None:
    """Writes the index of vectors (key, vec) to ``path``."""
    spark = vectors.sparkSession
    rows = vectors.select("key", F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())
    n = rows.count()
    key = rows.schema["key"].dataType.simpleString()
    if n:
        # at most SAMPLE vectors come to the driver
        sample = rows.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(SAMPLE).toPandas().vec
        x = search._units(np.stack([np.asarray(v, np.float64) for v in sample]))
        centres = search._centres(x, max(1, min(len(x), MOST_LISTS, lists or int(n**0.5))), seed)
        rest = x - centres[_order(x, centres, 1)[:, 0]]
        low, high = rest.min(0), rest.max(0)
    else:
        centres, low, high = np.zeros((1, 1)), np.zeros(1), np.zeros(1)
    step = np.where(high > low, (high - low) / LEVELS, 1.0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = search._units(_matrix(b.column("vec")))
                own = _order(x, centres, 1)[:, 0]
                codes = np.clip(np.round((x - centres[own] - low) / step), 0, LEVELS).astype(np.uint8)
                raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(codes.shape[1]), len(codes), [None, pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(own.astype(np.int32)), raw.cast(pa.binary())], names=["key", "list", "code"])

    dealt = rows.mapInArrow(deal, f"key {key}, list int, code binary")
    files = max(1, min(len(centres), -(-n // (16 * PART))))
    dealt.repartitionByRange(files, "list").sortWithinPartitions("list", "key").write.mode("overwrite").parquet(f"{path}/lists")
    model = [(centres.tolist(), low.tolist(), step.tolist(), n)]
    spark.createDataFrame(model, "centres array<array<double>>, low array<double>, step array<double>, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def _model(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    r = spark.read.parquet(f"{path}/model").first()
    return np.array(r.centres), np.array(r.low), np.array(r.step), r.n


def tune(vectors: DataFrame, path: str, k: int = 10, target: float = TARGET, seed: int = 7) -> int:
    """Lists to probe, so that the share ``target`` of true neighbours is in them; kept with the index. ``ASKED`` vectors are asked, against all."""
    spark = vectors.sparkSession
    centres = _model(spark, path)[0]
    asked = written(vectors.where(F.col("vec").isNotNull()).orderBy(F.xxhash64(F.lit(seed + 1), "key"), "key").limit(ASKED).select(F.col("key").alias("qid"), "vec"))
    true = written(search.knn(vectors, asked, k + 1).where("key <> qid").select("qid", "key"))
    places = true.join(spark.read.parquet(f"{path}/lists").select("key", "list"), "key").join(asked, "qid")
    # at most ASKED times k numbers come to the driver
    rows = places.select(F.col("vec").cast("array<double>").alias("vec"), "list").collect()
    if rows:
        order = _order(search._units(np.array([r.vec for r in rows])), centres, len(centres))
        found = np.sort((order == np.array([r.list for r in rows])[:, None]).argmax(1))
        probes = int(found[min(len(found) - 1, int(np.ceil(target * len(found))) - 1)]) + 1
    else:
        probes = 1
    spark.createDataFrame([(probes, k, target)], "probes int, k int, target double").coalesce(1).write.mode("overwrite").parquet(f"{path}/probes")
    return probes


def search_lists(vectors: DataFrame, queries: DataFrame, path: str, k: int = 10, probes: int | None = None, again: int = AGAIN) -> DataFrame:
    """(qid, key, score, rank): the ``k`` nearest found for queries (qid, vec); ``vectors`` (key, vec) are those of the index and score the last candidates."""
    spark = vectors.sparkSession
    centres, low, step, _ = _model(spark, path)
    if probes is None:
        probes = spark.read.parquet(f"{path}/probes").first().probes if _exists(spark, f"{path}/probes") else 16
    probes = min(probes, len(centres))
    q_type, key = queries.schema["qid"].dataType.simpleString(), vectors.schema["key"].dataType.simpleString()
    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec")).where(F.col("vec").isNotNull())

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = search._units(_matrix(b.column("vec")))
                first = _order(x, centres, probes)
                units = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
                at = pa.array(np.repeat(np.arange(len(b)), probes))
                yield pa.RecordBatch.from_arrays([b.column("qid").take(at), units.take(at), pa.array(first.ravel().astype(np.int32))], names=["qid", "unit", "list"])

    probed = asked.mapInArrow(order, f"qid {q_type}, unit array<double>, list int")
    listed = spark.read.parquet(f"{path}/lists")
    sizes = written(listed.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    dealt = listed.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))  # MOST_LISTS rows
    probed = probed.join(F.broadcast(sizes), "list").select("qid", "unit", F.col("list").alias("q_list"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q_part"))
    most = k * again

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"qid": right["qid"].slice(0, 0), "key": left["key"].slice(0, 0), "near": pa.array([], pa.float32())})
        codes = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, -1)
        x = (centres[left["list"][0].as_py()] + low + step * codes).astype(np.float32)
        q = _matrix(right["unit"].combine_chunks()).astype(np.float32)
        at, own, near = [], [], []
        for i in range(0, len(q), 512):
            score = q[i : i + 512] @ x.T
            best = np.argpartition(-score, most - 1, axis=1)[:, :most] if most < len(x) else np.broadcast_to(np.arange(len(x)), score.shape)
            at.append(np.repeat(np.arange(i, i + len(score)), best.shape[1]))
            own.append(best.ravel())
            near.append(np.take_along_axis(score, best, 1).ravel())
        take = lambda c, v: c.take(pa.array(np.concatenate(v)))
        return pa.table({"qid": take(right["qid"], at), "key": take(left["key"], own), "near": pa.array(np.concatenate(near))})

    met = dealt.groupBy("list", "part").cogroup(probed.groupBy("q_list", "q_part")).applyInArrow(rank, f"qid {q_type}, key {key}, near float")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("near"), "key"))
    few = met.withColumn("place", place).where(F.col("place") <= most).select("qid", "key")
    scored = few.join(vectors.select("key", F.col("vec").alias("v")), "key").join(asked, "qid")

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (search._units(np.stack([np.asarray(v, np.float64) for v in s])) for s in (a, b))
        return pd.Series(np.round((x * y).sum(1), 6))

    return search.topk(scored.select("qid", "key", F.pandas_udf(cosine, "double")("v", "vec").alias("score")), k)


def recall(vectors: DataFrame, queries: DataFrame, path: str, k: int = 10, probes: int | None = None) -> DataFrame:
    """(vectors, queries, k, lists, probes, recall): the share of the exact ``k`` nearest that ``search_lists`` finds, over all queries."""
    spark = vectors.sparkSession
    own = probes or spark.read.parquet(f"{path}/probes").first().probes
    found = search_lists(vectors, queries, path, k, own).select("qid", "key", F.lit(1).alias("found"))
    true = search.knn(vectors, queries, k).select("qid", "key")
    centres, _, _, n = _model(spark, path)
    share = F.round(F.coalesce(F.sum("found"), F.lit(0)) / F.count("*"), 4)
    return true.join(found, ["qid", "key"], "left").agg(F.lit(n).alias("vectors"), F.countDistinct("qid").alias("queries"), F.lit(k).alias("k"), F.lit(len(centres)).alias("lists"), F.lit(min(own, len(centres))).alias("probes"), share.alias("recall"))
