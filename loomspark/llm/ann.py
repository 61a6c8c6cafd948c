"""Nearest neighbours by inner product with a permutation index.

Some vectors, chosen by hash, are the pivots: about the square root of the number of vectors, ``MOST_PIVOTS`` at most. Each vector is the order
of its nearest pivots, and is posted in the inverted files of its first ``POSTED``. A query reads the files of its own first ``PROBED`` pivots.
Postings and probes meet in a cogroup by pivot, so a vector is moved ``POSTED`` times whatever the number of queries. In a file, vectors that
the query has met in a file of a nearer pivot are left out, the others are ranked by Spearman's footrule between the two orders, and the best
``RERANK`` of them get their inner product, in double precision.

Pivot order follows distance after vectors are lengthened by one component to a common norm, so that long vectors, which
inner products favour, are not missed. Files of more than ``LIST`` vectors or probes are dealt to several groups by hash. Equal vectors are searched
once: of each group of copies the ``k + 1`` smallest ids are kept before the shuffle, which is all that a result can hold.

A query visits about POSTED * PROBED / sqrt(n) of all n vectors, so work grows as n^1.5 while queries are a fixed share. Vectors without any
structure need a steady share of all vectors for a steady recall; then ``probed`` has to grow with the table. Recall against brute force is measured
in the tests (at least 0.9). Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as
queries or candidates; vectors of different lengths are never compared, and a length that ``FEW`` vectors or fewer have is one file; repeated
rows count once; equal scores go to the smaller id; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import materialize

MOST_PIVOTS, LEAST_PIVOTS, POSTED, PROBED, RERANK = 4096, 48, 6, 40, 0.7
LIST, BUNDLE, FEW = 4096, 4, 64


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows with a vector of finite numbers, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0) & F.coalesce(finite, F.lit(False)))


def matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of each row's nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)


def permutations(x: np.ndarray, pivots: np.ndarray, longest: float, posted: int, probed: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivots of each row as a candidate, and as a query. ``pivots`` have the spare component; both may have more components than ``x``."""
    spare = np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))
    d = x.shape[1]
    near = x @ pivots[:, :d].T
    asked = np.argsort(-near, axis=1, kind="stable")[:, :probed].astype(np.int32)
    near += spare[:, None] * pivots[:, -1]
    return np.argsort(-near, axis=1, kind="stable")[:, :posted].astype(np.int32), asked


def search_list(number: int, ids: np.ndarray, x: np.ndarray, posted: np.ndarray, q: np.ndarray, asked: np.ndarray, k: int, pivots: int, rerank: float = RERANK):
    """(query row, id, score) arrays: the best ``k`` of one inverted file for each query that probes it."""
    probed = asked.shape[1]
    out: list[list[np.ndarray]] = [[], [], []]
    step = max(1, 4_000_000 // max(1, len(x) * posted.shape[1]))
    for at in range(0, len(q), step):
        mine = asked[at : at + step]
        place = np.full((len(mine), pivots), probed, np.int16)
        np.put_along_axis(place, mine, np.arange(probed, dtype=np.int16)[None], 1)
        theirs = place[:, posted.ravel()].reshape(len(mine), *posted.shape)
        met = (theirs < place[:, number, None, None]).any(2)
        footrule = np.abs(theirs - np.arange(posted.shape[1], dtype=np.int16)).sum(2, dtype=np.int32)
        footrule[met] = 1 << 30
        most = min(len(x), max(k, int(np.ceil(rerank * len(x)))))
        best = np.argpartition(footrule, most - 1, axis=1)[:, :most] if most < len(x) else np.broadcast_to(np.arange(len(x)), (len(mine), len(x)))
        score = np.take_along_axis(q[at : at + step] @ x.T, best, 1)
        score[np.take_along_axis(met, best, 1)] = -np.inf
        if k < most:
            # ties at the k-th score are kept whole, as ids decide among them
            least = np.partition(score, most - k, axis=1)[:, most - k]
            row, col = np.nonzero((score >= least[:, None]) & (score > -np.inf))
        else:
            row, col = np.nonzero(score > -np.inf)
        out[0].append(row + at)
        out[1].append(ids[best[row, col]])
        out[2].append(score[row, col])
    return [np.concatenate(o) if o else np.zeros(0) for o in out]


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", posted: int = POSTED, probed: int = PROBED) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows found for each row for which ``is_query`` holds."""
    named = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vec).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("vec_id is not null")
    rows = usable(named, "x").withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    copies = Window.partitionBy("h1", "h2").orderBy("vec_id")
    kept = rows.withColumn("copy", F.dense_rank().over(copies)).where(F.col("copy") <= k + 1)
    kept = kept.withColumn("class", F.min("vec_id").over(copies.rowsBetween(Window.unboundedPreceding, 0))).dropDuplicates(["class", "copy"])
    members = materialize(kept.select("class", "vec_id", "h1", "h2", F.when(F.col("copy") == 1, F.col("x")).alias("x")))
    first = members.where("x is not null").select("class", "h1", "h2", "x", F.size("x").alias("d"))
    # all queries, also those beyond the first copies
    asking = materialize(rows.where("asks").select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(first.select("class", "h1", "h2"), ["h1", "h2"]).drop("h1", "h2"))
    shape = first.agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))).alias("long")).first()
    if not shape.n or not asking.head(1):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # MOST_PIVOTS vectors at most come to the driver and go to every task
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, int(shape.n**0.5)))
    longest = shape.long**0.5
    chosen = [np.asarray(r.x, np.float64) for r in first.orderBy(F.xxhash64("class"), "class").limit(count).select("x").collect()]
    pivots = np.zeros((len(chosen), shape.d + 1))
    for row, v in zip(pivots, chosen):
        row[: len(v)] = v
        row[-1] = np.sqrt(max(longest**2 - v @ v, 0))
    few = first.groupBy("d").agg((F.count("*") <= FEW).alias("few"))
    marked = first.drop("h1", "h2").join(few, "d").join(asking.select("class", F.lit(True).alias("asks")).distinct(), "class", "left")
    x_type = first.schema["x"].dataType.simpleString()

    def ordered(batches):
        for b in batches:
            near, asked = [None] * len(b), [None] * len(b)
            d, one_file, asks = np.asarray(b.column("d")), b.column("few").to_pylist(), b.column("asks").to_pylist()
            for length in np.unique(d):
                at = np.flatnonzero(d == length)
                a, q = permutations(matrix(b.column("x").take(pa.array(at))), pivots, longest, posted, probed)
                for i, own, mine in zip(at.tolist(), a.tolist(), q.tolist()):
                    near[i], asked[i] = ([0], [0]) if one_file[i] else (own, mine)
                    if not asks[i]:
                        asked[i] = None
            numbers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("class"), b.column("d"), b.column("x"), pa.array(near, numbers), pa.array(asked, numbers)], names=["class", "d", "x", "near", "asked"])

    found = materialize(marked.select("class", "d", "x", "few", "asks").mapInArrow(ordered, f"class long, d int, x {x_type}, near array<int>, asked array<int>"))
    postings = found.select("class", "d", "x", "near", F.explode("near").alias("list"))
    probes = found.where("asked is not null").select(F.col("class").alias("own"), "d", F.col("x").alias("y"), "asked", F.explode("asked").alias("list"))
    parts = lambda n: F.ceil(F.col(n) / LIST).cast("int")
    sizes = postings.groupBy("d", "list").agg(F.count("*").alias("n")).join(probes.groupBy("d", "list").agg(F.count("*").alias("q")), ["d", "list"])
    sizes = materialize(sizes.select("d", "list", parts("n").alias("parts"), parts("q").alias("q_parts")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    bundle = F.expr(f"list div {BUNDLE}").cast("int").alias("bundle")
    data = postings.join(sizes, ["d", "list"]).select("class", "x", "near", "list", "d", bundle, dealt("class", "parts").alias("part"), each("q_parts").alias("q_part"))
    asked = probes.join(sizes, ["d", "list"]).select("own", "y", "asked", "list", F.col("d").alias("qd"), bundle.alias("qbundle"), each("parts").alias("qpart"), dealt("own", "q_parts").alias("qq_part"))
    total = len(chosen)

    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            on, at = np.asarray(left["list"]), np.asarray(right["list"])
            ids, own, x, y = np.asarray(left["class"]), np.asarray(right["own"]), matrix(left["x"]), matrix(right["y"])
            near, mine = matrix(left["near"], np.int32), matrix(right["asked"], np.int32)
            for number in np.unique(on):
                a, b = on == number, at == number
                row, found, score = search_list(number, ids[a], x[a], near[a], y[b], mine[b], k + 1, total)
                for o, v in zip(out, (own[b][row.astype(int)], found, score)):
                    o.append(v)
        whole = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query": pa.array(whole[0].astype(np.int64)), "class": pa.array(whole[1].astype(np.int64)), "score": pa.array(whole[2], pa.float64())})

    pairs = data.groupBy("d", "bundle", "part", "q_part").cogroup(asked.groupBy("qd", "qbundle", "qpart", "qq_part")).applyInArrow(visit, "query long, class long, score double")
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "class"))).where(F.col("r") <= k + 1)
    full = best.select("query", "class", "score").join(members.select("class", "vec_id"), "class")
    full = full.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    told = asking.withColumnRenamed("class", "query").join(full.drop("r", "class"), "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return told.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
