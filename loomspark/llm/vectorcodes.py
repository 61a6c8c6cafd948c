"""Product codes of vectors, exact in integers: four parts, a codebook of 256 entries for each, four rounds of means.

Parts are sorted along a Hilbert curve, over all tasks by range, and cut into flat blocks of ``BLOCK`` neighbours that are written once with the box of
their components (least and largest) and their sums. A round goes by blocks: the distance of a box to each entry has a lower and an upper bound; an
entry whose lower bound is above another's upper bound is nearest to no part inside, nor is one that lies farther over the whole box than the entry nearest
to the block's mean. What is left is the block's shortlist. A block with one entry left adds its stored sums and is not looked at; the others measure
their parts against the shortlist alone. All distances are exact: products of floats where all numbers stay below 2^53, else 64-bit integers, else Python's.

Sums of a round are added up in each task, then by entry in a shuffle of 256 rows a task and part. A round's codebooks, 256 entries a part, are all that
comes to the driver and all that goes to the tasks.

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; a null label is a label of its own; repeated rows count as
often as they stand, but give one entry to start from (of unequal vectors under one id the least); rows without an id get codes, but start no codebook
unless no row has an id. Vectors of each length have codebooks of their own; a length that isn't a multiple of four is filled up by zeros, and an empty
vector has code 00000000 and error 0. Components of 2^50 or more count as 2^50, errors beyond a long as the largest one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import SMALL_ROWS, join_named, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK, BLOCKS_AT_ONCE = 128, 256
LARGEST, LONGEST = 1 << 60, (1 << 63) - 1
#: Components and bits of the Hilbert key: 16 x 3 bits.
AXES, BITS = 16, 3


def integers(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, floors) for each length: floor(1024 x) of the vectors, filled up to a multiple of four; ints of 64 bits."""
    lengths = np.asarray(column.value_lengths(), np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    with np.errstate(over="ignore"):
        flat = np.asarray(column.flatten(), np.float64) * SCALE
    flat = np.floor(np.clip(flat, -float(LARGEST), float(LARGEST))).astype(np.int64)
    found = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        x = np.zeros((len(rows), -(-d // PARTS) * PARTS), np.int64)
        x[:, :d] = flat[(offsets[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)
        found.append((rows, x))
    return found


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along a Hilbert curve of points whose coordinates have ``bits`` bits: the axes are turned and swapped bit by bit, then their bits interleaved."""
    x = x.astype(np.uint64).T.copy()
    one, n = np.uint64(1), len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(n):
            set_ = (x[i] & bit) != 0
            swapped = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swapped)
            x[i] ^= swapped
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[n - 1] >> np.uint64(b)) & one, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turned
    place = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            place = (place << one) | ((x[i] >> np.uint64(b)) & one)
    return place.astype(np.int64)


def places(part: np.ndarray, entries: list[list[int]]) -> np.ndarray:
    """Hilbert keys of parts, on a grid that the first codebook spans; the grid decides only how good blocks are."""
    own = np.array(entries, np.float64)
    axes = np.argsort(-np.ptp(own, axis=0), kind="stable")[:AXES]
    if not len(axes):
        return np.zeros(len(part), np.int64)
    mean, width = own[:, axes].mean(0), np.maximum(own[:, axes].std(0), 1)
    cells = np.floor((part[:, axes] - mean) / width * (1 << BITS) / 4 + (1 << BITS) / 2)
    return hilbert(np.clip(cells, 0, (1 << BITS) - 1))


def exact(*numbers: np.ndarray, width: int):
    """The type in which sums of ``width`` squared differences of these numbers are exact."""
    largest = max((max(-int(a.min()), int(a.max())) for a in numbers if a.size), default=0)
    bound = 8 * largest * largest * max(width, 1)
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object


def shortlist(low: np.ndarray, high: np.ndarray, sums: np.ndarray, count: int, entries: np.ndarray) -> np.ndarray:
    """Numbers of the entries that can be nearest to a point of the box, ascending."""
    kind = exact(low, high, entries, width=entries.shape[1])
    if kind is object or not entries.shape[1]:
        return np.arange(len(entries) if entries.shape[1] else 1)
    lo, hi, e = low.astype(kind), high.astype(kind), entries.astype(kind)
    under, over = e - lo, e - hi
    least = (np.maximum(np.maximum(-under, over), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(under), np.abs(over)) ** 2).sum(1)
    kept = np.flatnonzero(least <= most.min())
    if len(kept) > 1:
        # |x - near|^2 - |x - other|^2 is linear in x: largest at a corner of the box
        middle = kept[((e[kept] * count - sums.astype(kind)) ** 2).sum(1).argmin()] if kind is np.float64 else kept[most[kept].argmin()]
        step = 2 * (e[kept] - e[middle])
        gain = np.maximum(step * lo, step * hi).sum(1) + (e[middle] ** 2).sum() - (e[kept] ** 2).sum(1)
        # as near at best: the lower number wins
        kept = kept[(gain > 0) | ((gain == 0) & (kept < middle)) | (kept == middle)]
    return kept


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row's nearest entry, the first of equal ones, and its squared distance; exact."""
    kind = exact(x, entries, width=x.shape[1])
    a, e = x.astype(kind), entries.astype(kind)
    distance = (a * a).sum(1)[:, None] - 2 * (a @ e.T) + (e * e).sum(1) if x.shape[1] else np.zeros((len(x), len(e)), np.int64)
    at = distance.argmin(1)
    found = distance[np.arange(len(x)), at]
    return at, np.minimum(found, LONGEST).astype(np.int64)


BLOCK_TYPE = "d int, part int, n int, low array<long>, high array<long>, sums array<decimal(38,0)>, data array<long>, ids array<long>, vec_ids array<long>, labels array<{label}>"


def _blocks(sorted_parts: DataFrame) -> DataFrame:
    """Blocks of at most ``BLOCK`` neighbours of each task's sorted parts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, part = np.asarray(b.column("d")), np.asarray(b.column("part"))
            begins = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (part[1:] != part[:-1])]) if len(d) else np.zeros(0, int)
            spans = [(a, min(a + BLOCK, z)) for s, z in zip(begins, np.r_[begins[1:], len(d)]) for a in range(s, z, BLOCK)]
            rows: list[list] = [[] for _ in range(10)]
            for a, z in spans:
                own = b.slice(a, z - a)
                x = np.asarray(own.column("x").flatten(), np.int64).reshape(z - a, -1)
                whole = x.astype(object).sum(0) if x.size and int(np.abs(x).max()) > 1 << 50 else x.sum(0)
                made = (int(d[a]), int(part[a]), z - a, x.min(0), x.max(0), [int(v) for v in whole], x.ravel(), *(own.column(c) for c in ("id", "vec_id", "label")))
                for r, v in zip(rows, made):
                    r.append(v.to_pylist() if isinstance(v, pa.Array) else v)
            longs, label = pa.list_(pa.int64()), pa.list_(b.schema.field("label").type)
            types = (pa.int32(), pa.int32(), pa.int32(), longs, longs, pa.list_(pa.decimal128(38, 0)), longs, longs, longs, label)
            names = ("d", "part", "n", "low", "high", "sums", "data", "ids", "vec_ids", "labels")
            sums = [[*map(_decimal, s)] for s in rows[5]]
            arrays = [pa.array(sums if i == 5 else r, t) for i, (r, t) in enumerate(zip(rows, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=list(names))

    label = sorted_parts.schema["label"].dataType.simpleString()
    return sorted_parts.mapInArrow(cut, BLOCK_TYPE.format(label=label))


def _decimal(v: int):
    from decimal import Decimal

    return Decimal(v)


def _visit(b: pa.RecordBatch, books: dict[tuple[int, int], np.ndarray]) -> Iterator[tuple]:
    """(row, d, part, shortlist, x, low, high) of each block; ``x`` is None where one entry is left."""
    for row in range(b.num_rows):
        d, part = b.column("d")[row].as_py(), b.column("part")[row].as_py()
        entries = books[d, part]
        low, high = (np.asarray(b.column(c)[row].values, np.int64) for c in ("low", "high"))
        n = b.column("n")[row].as_py()
        sums = np.array([int(v) for v in b.column("sums")[row].as_py()], object)
        yield row, d, part, n, sums, shortlist(low, high, sums, n, entries), entries


def _points(b: pa.RecordBatch, row: int, n: int) -> np.ndarray:
    return np.asarray(b.column("data")[row].values, np.int64).reshape(n, -1)


def _add(sums: np.ndarray, counts: np.ndarray, x: np.ndarray, at: np.ndarray, entries: np.ndarray) -> None:
    """Adds the rows of ``x`` to the sums of the entries that they are nearest to."""
    order = np.argsort(at, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    own = x[order].astype(object) if x.size and max(-int(x.min()), int(x.max())) > 1 << 50 else x[order]
    to = entries[at[order][begins]]
    sums[to] += np.add.reduceat(own, begins, axis=0).astype(object)
    counts[to] += np.diff(np.r_[begins, len(at)])


def _round(blocks: DataFrame, books: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """The codebooks after one round of means."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(e.shape, object) for k, e in books.items()}
        counts = {k: np.zeros(len(e), np.int64) for k, e in books.items()}
        for b in batches:
            for row, d, part, n, total, entries, book in _visit(b, books):
                if len(entries) == 1:
                    sums[d, part][entries[0]] += total
                    counts[d, part][entries[0]] += n
                else:
                    x = _points(b, row, n)
                    _add(sums[d, part], counts[d, part], x, nearest(x, book[entries])[0], entries)
        rows = [(d, part, e, int(counts[d, part][e]), [_decimal(int(v)) for v in sums[d, part][e]]) for d, part in books for e in np.flatnonzero(counts[d, part]).tolist()]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], names=["d", "part", "entry", "n", "sums"])

    used = blocks.select("d", "part", "n", "low", "high", "sums", "data").mapInArrow(meet, "d int, part int, entry int, n long, sums array<decimal(38,0)>")
    each = used.select("d", "part", "entry", "n", F.posexplode_outer("sums").alias("pos", "v"))
    added = each.groupBy("d", "part", "entry", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    # at most 256 entries a part and length
    made = {k: e.copy() for k, e in books.items()}
    for r in added.where("pos is not null").collect():
        made[r.d, r.part][r.entry, r.pos] = int(r.v) // r.n
    return made


def digest(books: dict[tuple[int, int], np.ndarray], d: int) -> str:
    numbers = ",".join(str(int(v)) for part in range(PARTS) for entry in books[d, part] for v in entry)
    return hashlib.sha256(numbers.encode()).hexdigest()


def encode(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row that has a vector of finite numbers."""
    spark = vectors.sparkSession
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = named.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))

    # the first codebooks: at most 256 vectors a length come to the driver
    shaped = kept.withColumn("d", F.size("v"))
    lengths = [r.d for r in shaped.select("d").distinct().collect()]
    books: dict[tuple[int, int], np.ndarray] = {}
    for d in lengths:
        own = shaped.where(F.col("d") == d)
        ids = own.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(ENTRIES)
        first = [r.v for r in own.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()]
        first = first or [r.v for r in own.select("v").distinct().orderBy("v").limit(ENTRIES).collect()]
        x = integers(pa.array(first, pa.list_(pa.float64())))[0][1]
        for part, own in enumerate(np.split(x, PARTS, axis=1)):
            books[d, part] = own
    out = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if not books:
        return spark.createDataFrame([], out)

    starts = dict(books)
    label_type = named.schema["label"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = np.asarray(b.column("v").value_lengths())
            for rows, x in integers(b.column("v")):
                d = int(size[rows[0]])
                own = b.take(pa.array(rows))
                width = x.shape[1] // PARTS
                for part in range(PARTS):
                    mine = np.ascontiguousarray(x[:, part * width : (part + 1) * width])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(mine.ravel()))
                    key = places(mine, starts[d, part])
                    constant = lambda v: pa.array(np.full(len(rows), v, np.int32))
                    yield pa.RecordBatch.from_arrays([own.column("id"), own.column("vec_id"), own.column("label"), constant(d), constant(part), lists, pa.array(key)], names=["id", "vec_id", "label", "d", "part", "x", "place"])

    parts = kept.withColumn("id", F.monotonically_increasing_id()).mapInArrow(cut, f"id long, vec_id long, label {label_type}, d int, part int, x array<long>, place long")
    # equal parts have one place: the row's number parts them
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = materialize(parts)
    ranged = parts.repartitionByRange(tasks, "d", "part", "place", F.xxhash64("id")).sortWithinPartitions("d", "part", "place")
    blocks = materialize(_blocks(ranged))
    for _ in range(rounds):
        books = _round(blocks, books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, d, part, n, _, entries, book in _visit(b, books):
                at, error = nearest(_points(b, row, n), book[entries])
                own = [b.column(c)[row].values for c in ("ids", "vec_ids", "labels")]
                constant = lambda v: pa.array(np.full(n, v, np.int32))
                yield pa.RecordBatch.from_arrays([*own, constant(d), constant(part), pa.array(entries[at].astype(np.int32)), pa.array(error)], names=["id", "vec_id", "label", "d", "part", "entry", "error"])

    told = blocks.mapInArrow(assign, f"id long, vec_id long, label {label_type}, d int, part int, entry int, error long")
    hexed = F.lower(F.lpad(F.hex("entry"), 2, "0"))
    together = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", hexed.alias("h")))), lambda p: p["h"]), "")
    capped = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    rows = materialize(told.groupBy("id", "vec_id", "label", "d").agg(together.alias("code"), capped("error").alias("error")))
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit(0).cast(label_type)).alias("label"))
    keyed = rows.withColumn("_key", key)
    labels = materialize(keyed.groupBy("_key").agg(capped("error").alias("label_error"), F.count("*").alias("n")))
    if labels.count() <= SMALL_ROWS:
        joined = keyed.join(F.broadcast(labels.drop("n")), "_key", "left")
    else:
        joined = join_named(keyed, labels.drop("n"), "_key", labels.where(F.col("n") > SMALL_ROWS), "id")
    digests = F.create_map(*(F.lit(v) for d in lengths for v in (d, digest(books, d))))
    return joined.select("vec_id", "code", "error", "label_error", F.element_at(digests, F.col("d")).alias("codebooks_sha256"))
