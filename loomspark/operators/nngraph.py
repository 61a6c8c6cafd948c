"""The graph of nearest neighbours by descent: neighbours of neighbours are compared until few lists change.

Vectors get one short list each. The first lists come from leaves: the nearest of a few random directions deals the vectors out ``TREES`` times, and vectors of
one leaf are compared with each other. A leaf is a ``SHARE``-th of the vectors, from ``LEAF`` to ``MOST_LEAF`` of them: comparing within a leaf moves a vector once,
while a round moves it to each node that looks at it, so large leaves spare rounds. Then come rounds. In each, a node looks at ``JOINED`` neighbours of its own
list and as many nodes that have it in theirs, new ones first, and compares these with each other, but for pairs that met in an earlier round; a pair goes on
to the lists that it would improve. No step pairs all vectors of a large table: a node's work is bounded by ``MOST_LEAF`` for each tree and by ``JOINED`` in a round.

Lists are measured against the true neighbours of ``PROBES`` nodes, which are compared with all: rounds end when the lists hold ``RECALL`` of them. When less than
``LEAST_CHANGE`` of all entries change and that isn't reached, other directions deal the vectors out anew.

Nodes are worked on by buckets of ``BUCKET``, so tasks compute on whole arrays. Leaves of more than twice their size (a crowd of copies is one) are dealt
out by hash; what such a leaf parts, other trees and the rounds bring together. Lists of the nodes that point at a hub are cut by a ranked window
before they are shuffled.

Results are approximate, with scores from single precision; ``search.neighbors`` is the exact graph. Vectors that are null take no part; a zero vector's
score is 0 with all others. A repeated key is another node, and so may be its own neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.sources.scratch import written

TREES, LEAF, JOINED, BUCKET = 8, 256, 24, 2048
SHARE, MOST_LEAF = 12, 8192
PROBES, RECALL = 256, 0.95
LEAST_CHANGE, MOST_ROUNDS = 0.002, 15
LISTS = "bucket int, id long, near array<long>, score array<float>, fresh array<boolean>"
PROPOSED = "bucket int, id long, near long, score float"


def _units(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float32).reshape(len(column), -1)


def _longs(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column, np.int64)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _best(own: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each node's ``k`` best neighbours, each once, sorted by node and rank."""
    order = np.lexsort((near, -score, own))
    o, n = own[order], near[order]
    # one pair has one score, up to the last bit: equal pairs are looked for by number
    by_pair = np.lexsort((np.arange(len(o)), n, o))
    twice = np.r_[False, (o[by_pair][1:] == o[by_pair][:-1]) & (n[by_pair][1:] == n[by_pair][:-1])][: len(o)]
    keep = np.ones(len(o), bool)
    keep[by_pair[twice]] = False
    order, o = order[keep], o[keep]
    begins = np.flatnonzero(np.r_[True, o[1:] != o[:-1]]) if len(o) else np.zeros(0, int)
    rank = np.arange(len(o)) - np.repeat(begins, np.diff(np.r_[begins, len(o)]))
    return order[rank < k]


def _proposals(own: np.ndarray, near: np.ndarray, score: np.ndarray, nodes_per_bucket: int) -> pa.Table:
    return pa.table({"bucket": pa.array((own // nodes_per_bucket).astype(np.int32)), "id": own, "near": near, "score": score.astype(np.float32)})


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """(bucket, id, key, x) with unit vectors, numbered from 0; the number of nodes, and of components."""
    rows = written(vectors.select("key", "vec").where(F.col("vec").isNotNull()).withColumn("p", F.spark_partition_id()))
    sizes = {r.p: r.n for r in rows.groupBy("p").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not total:
        return rows, 0, 0
    d = rows.select(F.size("vec")).first()[0]
    key_type = rows.schema["key"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("vec").flatten(), np.float64).reshape(len(b), -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), _lists(x)], names=["id", "key", "x"])

    first = F.create_map(*(F.lit(v) for p in starts for v in (p, starts[p])))
    place = F.row_number().over(Window.partitionBy("p").orderBy("key", "vec")) - 1
    numbered = rows.withColumn("id", (F.element_at(first, F.col("p")) + place).cast("long")).select("id", "key", F.col("vec").cast("array<double>").alias("vec"))
    made = numbered.mapInArrow(number, f"id long, key {key_type}, x array<float>")
    return written(made.withColumn("bucket", F.expr(f"id div {BUCKET}").cast("int"))), total, d


def _leaves(nodes: DataFrame, n: int, d: int, k: int, trees: int, seed: int) -> DataFrame:
    """First proposals (bucket, id, near, score): the best of each leaf that a node is in."""
    size = min(max(LEAF, n // SHARE), MOST_LEAF)
    leaves = -(-n // size)
    directions = np.random.default_rng(seed).normal(size=(d, trees * leaves)).astype(np.float32)
    directions /= np.linalg.norm(directions, axis=0, keepdims=True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = (_units(b.column("x")) @ directions).reshape(len(b), trees, leaves).argmax(2)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(np.full(len(b), t, np.int32)), pa.array(leaf[:, t].astype(np.int64))], names=["id", "x", "tree", "leaf"])

    dealt = nodes.select("id", "x").mapInArrow(deal, "id long, x array<float>, tree int, leaf long")
    crowded = dealt.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * size)
    parts = dealt.join(crowded, ["tree", "leaf"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce(F.ceil(F.col("n") / size), F.lit(1))).cast("int"))

    def compare(table: pa.Table) -> pa.Table:
        ids, x = _longs(table["id"]), _units(table["x"])
        most = min(k, len(ids) - 1)
        near, found = [ids[:0]], [np.zeros(0, np.float32)]
        for at in range(0, len(ids) if most else 0, 1024):
            score = x[at : at + 1024] @ x.T
            score[np.arange(len(score)), np.arange(at, at + len(score))] = -np.inf
            best = np.argpartition(score, len(ids) - most, axis=1)[:, -most:]
            near.append(ids[best].ravel())
            found.append(np.take_along_axis(score, best, 1).ravel())
        return _proposals(np.repeat(ids, most), np.concatenate(near), np.concatenate(found), BUCKET)

    return parts.select("tree", "leaf", "part", "id", "x").groupBy("tree", "leaf", "part").applyInArrow(compare, PROPOSED)


def _probed(nodes: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """(id, least): a sample of ``PROBES`` nodes, each with the score of its ``k``-th nearest of all other nodes."""
    chosen = np.random.default_rng(seed).choice(n, min(n, PROBES), replace=False)
    rows = nodes.where(F.col("id").isin([int(i) for i in chosen])).select("id", "x").collect()
    asked, x = np.array([r.id for r in rows]), np.array([r.x for r in rows], np.float32)
    most = min(k, n - 1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.full((len(asked), 0), -np.inf, np.float32)
        for b in batches:
            score = x @ _units(b.column("x")).T
            score[asked[:, None] == _longs(b.column("id"))[None, :]] = -np.inf
            held = -np.sort(-np.concatenate([held, score], 1), axis=1)[:, :most]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, held.shape[1])), pa.array(held.ravel())], names=["id", "score"])

    scores = nodes.select("id", "x").mapInArrow(best, "id long, score float")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score")))
    return written(scores.withColumn("r", place).where(F.col("r") == most).select("id", F.col("score").alias("least")))


def _reached(lists: DataFrame, probed: DataFrame, most: int) -> float:
    """The part of the sample's true neighbours that lists hold; one that scores as the last of them does is as good."""
    held = F.size(F.filter(F.slice("score", 1, most), lambda s: s >= F.col("least") - 1e-5))
    return probed.join(lists.select("id", "score"), "id", "left").agg(F.avg(F.when(F.col("score").isNull(), 0).otherwise(held)) / most).first()[0]


def _merge(k: int):
    """Old lists and proposals of one bucket to new lists; what wasn't in the old list is fresh."""

    def run(old: pa.Table, new: pa.Table) -> pa.Table:
        had = old["near"].combine_chunks()
        lengths = np.asarray(had.value_lengths(), np.int64) if len(had) else np.zeros(0, np.int64)
        own = np.r_[np.repeat(_longs(old["id"]), lengths), _longs(new["id"])]
        near = np.r_[np.asarray(had.flatten(), np.int64), _longs(new["near"])]
        score = np.r_[np.asarray(old["score"].combine_chunks().flatten(), np.float32), np.asarray(new["score"], np.float32)]
        before = int(lengths.sum())
        # of equal pairs the old one stays: its flag tells whether it has been compared
        stands = np.r_[np.ones(before, bool), ~np.isin(_pairs(own[before:], near[before:]), _pairs(own[:before], near[:before]))]
        kept = np.flatnonzero(stands)
        kept = kept[_best(own[kept], near[kept], score[kept], k)]
        flags = np.r_[np.asarray(old["fresh"].combine_chunks().flatten(), bool), np.ones(len(own) - before, bool)][kept]
        ids, begins = np.unique(own[kept], return_index=True)
        offsets = pa.array(np.r_[begins, len(kept)].astype(np.int32))
        column = lambda v: pa.ListArray.from_arrays(offsets, pa.array(v))
        changed = int((kept >= before).sum())
        bucket = (ids // BUCKET).astype(np.int32)
        count = np.zeros(len(ids), np.int64)
        count[:1] = changed
        return pa.table({"bucket": bucket, "id": ids, "near": column(near[kept]), "score": column(score[kept]), "fresh": column(flags), "changed": count})

    return run


def _pairs(own: np.ndarray, near: np.ndarray) -> np.ndarray:
    return np.stack([own, near], 1).astype(np.int64).copy().view([("o", np.int64), ("n", np.int64)]).ravel()


def _meet(joined: int):
    """Proposals from one bucket's nodes: the nodes around each are compared with each other."""

    def run(table: pa.Table) -> pa.Table:
        own, ids, x = _longs(table["own"]), _longs(table["id"]), _units(table["x"])
        fresh, worst = np.asarray(table["fresh"]), np.asarray(table["worst"], np.float32)
        order = np.argsort(own, kind="stable")
        own, ids, x, fresh, worst = own[order], ids[order], x[order], fresh[order], worst[order]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        place = np.arange(len(own)) - np.repeat(begins, np.diff(np.r_[begins, len(own)]))
        row = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(own)]))
        out: list[list[np.ndarray]] = [[], [], []]
        wide = int(place.max()) + 1
        step = max(1, 4_000_000 // (wide * max(wide, x.shape[1])))
        for at in range(0, len(begins), step):
            sel = slice(begins[at], begins[at + step] if at + step < len(begins) else len(own))
            r, p, count = row[sel] - at, place[sel], min(step, len(begins) - at)
            grid = lambda v, empty: _grid(v[sel], r, p, count, wide, empty)  # noqa: B023, E731
            i, f, w, v = grid(ids, -1), grid(fresh, False), grid(worst, np.inf), grid(x, 0)
            score = np.matmul(v, v.transpose(0, 2, 1))
            new = (f[:, :, None] | f[:, None, :]) & (i[:, :, None] != i[:, None, :]) & (i[:, None, :] >= 0)
            g, a, b = np.nonzero(new & (score > w[:, :, None]))
            out[0].append(i[g, a])
            out[1].append(i[g, b])
            out[2].append(score[g, a, b])
        a, b, s = (np.concatenate(o) for o in out)
        kept = _best(a, b, s, joined)
        return _proposals(a[kept], b[kept], s[kept], BUCKET)

    return run


def _grid(values: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int, wide: int, empty) -> np.ndarray:
    made = np.full((rows, wide, *values.shape[1:]), empty, values.dtype)
    made[row, place] = values
    return made


def descend(vectors: DataFrame, k: int = 15, wide: int | None = None, trees: int = TREES, joined: int = JOINED, seed: int = 7, least_change: float = LEAST_CHANGE, most_rounds: int = MOST_ROUNDS, recall: float = RECALL) -> DataFrame:
    """(key, neighbor, score, rank): about the ``k`` nearest other vectors (key, vec) of each by cosine. Lists are ``wide`` while they are worked on, so that more are found."""
    wide = wide or 4 * k
    nodes, n, d = nodes_of(vectors)
    key_type = vectors.schema["key"].dataType.simpleString()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], f"key {key_type}, neighbor {key_type}, score double, rank int")
    spark = vectors.sparkSession
    counted = LISTS + ", changed long"
    none = spark.createDataFrame([], counted)

    def merged(lists: DataFrame, proposed: DataFrame) -> DataFrame:
        return written(lists.groupBy("bucket").cogroup(proposed.groupBy("bucket")).applyInArrow(_merge(wide), counted))

    probed, near = _probed(nodes, n, k, seed), min(k, n - 1)
    lists = merged(none, _leaves(nodes, n, d, wide, trees, seed))
    changed = n * wide
    for turn in range(most_rounds):
        if _reached(lists, probed, near) >= recall:
            break
        if changed <= least_change * n * wide:
            lists = merged(lists.drop("changed"), _leaves(nodes, n, d, wide, trees, seed + turn + 1))
            changed = n * wide
            continue
        # what a node looks at: fresh neighbours first, on both sides; worst is what a proposal must beat
        entries = lists.select("id", F.posexplode(F.arrays_zip("near", "fresh")).alias("pos", "e")).select("id", "pos", "e.near", "e.fresh")
        first = lambda c, by: F.row_number().over(Window.partitionBy(c).orderBy(F.desc("fresh"), *by))
        mine = entries.withColumn("r", first("id", ["pos"])).where(F.col("r") <= joined)
        looked = mine.select(F.col("id").alias("own"), F.col("near").alias("id"), "fresh")
        theirs = entries.withColumn("r", first("near", [F.xxhash64("id", F.lit(turn))])).where(F.col("r") <= joined)
        looked = written(looked.unionByName(theirs.select(F.col("near").alias("own"), "id", "fresh")).groupBy("own", "id").agg(F.max("fresh").alias("fresh")))
        worst = lists.select("id", F.when(F.size("score") < wide, F.lit(-2.0)).otherwise(F.array_min("score")).cast("float").alias("worst"))
        known = nodes.select("id", "x").join(worst, "id", "left").withColumn("worst", F.coalesce("worst", F.lit(-2.0).cast("float")))
        around = looked.join(known, "id").withColumn("b", F.expr(f"own div {BUCKET // 2}"))
        proposed = around.groupBy("b").applyInArrow(_meet(wide), PROPOSED)
        # entries that a node has looked at are fresh no more
        seen = mine.where("fresh").groupBy("id").agg(F.collect_set("near").alias("seen"))
        old = lists.drop("changed").join(seen, "id", "left")
        flags = F.transform(F.arrays_zip("near", "fresh"), lambda e: e["fresh"] & ~F.coalesce(F.array_contains("seen", e["near"]), F.lit(False)))
        old = old.select("bucket", "id", "near", "score", flags.alias("fresh"))
        lists = merged(old, proposed)
        changed = lists.agg(F.sum("changed")).first()[0]
    best = lists.select("id", F.posexplode(F.arrays_zip("near", "score")).alias("rank", "e")).where(F.col("rank") < k)
    names = nodes.select("id", "key")
    told = best.select("id", "rank", F.col("e.near").alias("near"), F.col("e.score").alias("score"))
    told = told.join(names, "id").join(names.select(F.col("id").alias("near"), F.col("key").alias("neighbor")), "near")
    return told.select("key", "neighbor", F.round(F.col("score").cast("double"), 6).alias("score"), "rank")
