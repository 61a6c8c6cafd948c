"""A 3-D map of vectors: seeded random projection, principal axes, unit ball."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.sources.scratch import written

DIMS, SEED = 96, 7


def project(vectors: DataFrame, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """(key, vec): unit vectors times a Gaussian matrix that the seed fixes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.vec.to_list()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                m = np.random.default_rng(seed).normal(size=(x.shape[1], dims)) / np.sqrt(dims)
                yield pd.DataFrame({"key": pdf.key, "vec": list(x @ m)})

    return vectors.select("key", "vec").mapInPandas(run, f"key {vectors.schema['key'].dataType.simpleString()}, vec array<double>")


def normalize(points: DataFrame) -> DataFrame:
    """Points (key, x, y, z) moved to their centroid and scaled into the unit ball."""
    c = points.agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    moved = points.crossJoin(F.broadcast(c)).select("key", *((F.col(a) - F.col(f"c{a}")).alias(a) for a in "xyz"))  # one row
    r = moved.agg(F.max(F.sqrt(F.expr("x * x + y * y + z * z"))).alias("r"))
    return moved.crossJoin(F.broadcast(r)).select("key", *(F.round(F.when(F.col("r") > 0, F.col(a) / F.col("r")).otherwise(0.0), 4).alias(a) for a in "xyz"))


def map3d(vectors: DataFrame) -> DataFrame:
    """(key, x, y, z): the three principal axes of the projected vectors; fewer than four points lie in the origin."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if len(vectors.take(4)) < 4:
        return vectors.select("key", *(F.lit(0.0).alias(a) for a in "xyz"))
    rows = project(vectors).select("key", array_to_vector("vec").alias("v"))
    got = PCA(k=3, inputCol="v", outputCol="p").fit(rows).transform(rows).select("key", vector_to_array("p").alias("p"))
    return normalize(got.select("key", *(F.col("p")[i].alias(a) for i, a in enumerate("xyz"))))


def spectral3d(graph: DataFrame, steps: int = 24, seed: int = SEED) -> DataFrame:
    """(key, x, y, z): a map by the graph of neighbours (key, neighbor): near are nodes between which many short paths lead.

    The three slowest modes of a lazy walk on the graph, by power iteration: a step is one join of the edges with the coordinates and one sum by node, then
    the modes are made orthogonal to each other and to the walk's resting state by their ten dot products. A run starts from hashes of the keys and
    turns each mode so that its largest coordinate is positive, so reruns agree up to rounding. Fewer than four nodes lie in the origin.
    """
    axes = ("x", "y", "z")
    both = graph.select(F.col("key").alias("a"), F.col("neighbor").alias("b")).where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = written(both.groupBy("a").agg(F.sqrt(F.count("*")).alias("root")))
    if len(degree.take(4)) < 4:
        return degree.select(F.col("a").alias("key"), *(F.lit(0.0).alias(c) for c in axes))
    edges = both.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("root").alias("other")), "b")
    edges = written(edges.select("a", "b", (1 / (F.col("root") * F.col("other"))).alias("w")))
    start = lambda i: F.pmod(F.xxhash64(F.lit(seed + i), "a"), F.lit(2_000_001)) / 1_000_000 - 1
    now = _orthogonal(written(degree.select("a", "root", *(start(i).alias(c) for i, c in enumerate(axes)))))
    for _ in range(steps):
        met = edges.join(now.select(F.col("a").alias("b"), *axes), "b").groupBy("a").agg(*(F.sum(F.col(c) * F.col("w")).alias(f"s{c}") for c in axes))
        moved = now.join(met, "a").select("a", "root", *((F.col(c) / 2 + F.col(f"s{c}") / 2).alias(c) for c in axes))
        now = _orthogonal(written(moved))
    places = now.select(F.col("a").alias("key"), *((F.col(c) / F.col("root")).alias(c) for c in axes))
    places = written(places)
    top = {c: places.orderBy(F.desc(F.abs(c)), "key").first()[c] for c in axes}
    return normalize(places.select("key", *((F.col(c) if top[c] >= 0 else -F.col(c)).alias(c) for c in axes)))


def _orthogonal(rows: DataFrame) -> DataFrame:
    """``x``, ``y`` and ``z`` made orthogonal to ``root`` and to each other, each of length one; by the dot products, the only numbers that come to the driver."""
    names = ("root", "x", "y", "z")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    dots = rows.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs)).first()
    gram = np.array([[dots[f"{a}_{b}"] if (a, b) in pairs else dots[f"{b}_{a}"] for b in names] for a in names])
    made: list[np.ndarray] = []
    for i in range(4):
        v = np.eye(4)[i]
        for _ in range(2):
            for u in made:
                v = v - (u @ gram @ v) * u
        size = float(v @ gram @ v)
        made.append(v / np.sqrt(size) if size > 1e-24 else np.zeros(4))
    mixed = {n: sum((F.col(m) * float(made[i][j]) for j, m in enumerate(names) if made[i][j]), F.lit(0.0)) for i, n in enumerate(names)}
    return rows.select("a", "root", *(mixed[c].alias(c) for c in names[1:]))


def update(vectors: DataFrame, target: str, stamp: str) -> DataFrame:
    """The map at ``target``, made anew only if ``stamp`` differs from the last one written. The stamp is written last, so a failed run is repeated."""
    spark = vectors.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/stamp/_SUCCESS")
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    last = spark.read.schema("version long, stamp string").json(f"{target}/stamp").orderBy(F.desc("version")).first() if known else None
    version = last.version if last else 0
    if last is None or last.stamp != stamp:
        version += 1
        map3d(vectors).write.mode("overwrite").parquet(f"{target}/points/v={version}")
        spark.createDataFrame([(version, stamp)], "version long, stamp string").write.mode("append").json(f"{target}/stamp")
    return spark.read.parquet(f"{target}/points/v={version}")


def compact(points: DataFrame) -> DataFrame:
    """(point): one array of key, rounded coordinates and, where there are such columns, area and label of each point."""
    more = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("area", "label") if c in points.columns]
    return points.select(F.array(F.col("key").cast("string"), *(F.round(a, 4).cast("string") for a in "xyz"), *more).alias("point"))


def area_counts(points: DataFrame, by_module: bool = False) -> DataFrame:
    """Chunks of each area, or of each of its modules."""
    return points.groupBy("area", *(["module"] if by_module else [])).agg(F.count("*").alias("n"))


def focus(points: DataFrame, hits: DataFrame) -> DataFrame:
    """Centroid of hits (key, w) weighted by ``w``."""
    j = points.join(hits, "key")
    return j.agg(*(F.round(F.try_divide(F.sum(F.col(a) * F.col("w")), F.sum("w")), 4).alias(a) for a in "xyz"))
