"""A kept inverted index: postings by parts of documents with their maxima, changed by document hash, read only where the best can be.

An index is a folder of segments, each written once, in the scan that reads the texts: neither a text nor a posting is shuffled or kept anywhere else. A
task's documents are cut, in the order in which it reads them, into parts of ``PER_PART`` ranges of ``RANGE``, fewer where texts are very long. A term has one row in a part: the
places of the documents that hold it and its frequencies there, and beside them, for each range, the largest frequency and the least length. As BM25 grows with
the one and falls with the other, these bound what a range can give, whatever the mean length is by then. A part's rows leave Python in the order of ``BUCKETS`` hash
buckets of terms and need no sort, in which they would be spilled; a few questions read the pages of their terms' buckets. A row without a term has the part's documents (keys, hashes, lengths),
in the bucket ``DOCS``. Terms' document counts are added up for those terms alone that a question asks for.

``update`` compares documents with the newest version by hash: new and changed ones become a segment, changed and vanished ones are entered as dead, with the
counts that their terms lose, so every count is exact at once. The manifest that names segments and counts is created only if it isn't there:
one of two writers is refused. Dead documents' postings go when ``compact`` writes one segment anew.

``search`` goes in two steps, like block-max retrieval. Bounds of a question's terms are added up by range. The ranges of the largest bounds are
scored first; the k-th best score found there is what a document must reach. Then the ranges that can reach it are scored, all others never. A range is
scored with all terms of the question or not at all, so every score is whole: the rows are those of ``search.text_search``.

Documents without terms have no part in counts and means, as in ``text_search``. Null keys take no part. An index that was never written finds nothing.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.memory import trim
from loomspark.operators import search, words
from loomspark.sources import manifest
from loomspark.sources.scratch import written

RANGE, BUCKETS, FIRST, PER_PART, DOCS = 256, 32, 4, 8, -1
#: Changed documents in one range's worth of segments: beyond so many segments ``update`` says that compacting is due.
MANY_SEGMENTS = 16
#: Rows of a Parquet page of blocks. Postings at which a part ends before it is full; rows, and characters of keys or marks, up to which a counted table is handed to every task.
PAGE, MOST_PAIRS, FEW_ROWS, FEW_CHARS = 4000, 1_000_000, 2_000_000, 32_000_000


def _impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / mean))


def _part(range_: str = "range") -> Column:
    return F.expr(f"{range_} div {PER_PART}")


def _handed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` handed to every task if its ``rows``, which have been counted, are few."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


class Index:
    """One version of the index at ``path``."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.content = manifest.read(spark, self.path, version)
        self.segments: list[str] = self.content.get("segments", [])
        self.key_type: str = self.content.get("key_type", "string")
        if self.segments and "range" not in self.content:
            raise ValueError(f"{self.path}: written in an older format; make the index anew")
        #: Documents in a range and buckets of terms of this index.
        self.range: int = self.content.get("range", RANGE)
        self.buckets: int = self.content.get("buckets", BUCKETS)

    def _rows(self) -> DataFrame:
        return self._read([f"parts/{s}" for s in self.segments], _schema(self.key_type))

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    def bucket(self) -> Column:
        """That of ``term``."""
        return F.pmod(F.crc32("term"), F.lit(self.buckets)).cast("int").alias("bucket")

    def blocks(self) -> DataFrame:
        """(bucket, term, part, n, ranges, max_tfs, min_lens, at, tfs): a term's documents in a part by their places, and what bounds each of its ranges."""
        return self._rows().where(F.col("bucket") != DOCS).select("bucket", "term", "part", "n", "ranges", "max_tfs", "min_lens", "at", "tfs")

    def parts(self) -> DataFrame:
        """(part, keys, hashes, lens): the documents of each part, the dead included."""
        return self._rows().where(F.col("bucket") == DOCS).select("part", "keys", "hashes", "lens")

    def dead(self) -> DataFrame:
        """(part, at) of documents that a later version changed or lost."""
        return self._read(self.content.get("dead", []), "part long, at int")

    def lost(self) -> DataFrame:
        """(term, df): what counts of terms lose by the dead."""
        return self._read(self.content.get("lost", []), "term string, df long")

    def docs(self) -> DataFrame:
        """(key, hash, len, part, at) of the live documents; the dead are few against them or compacting is due."""
        rows = self.parts().select("part", F.posexplode(F.arrays_zip("keys", "hashes", "lens")).alias("at", "e"))
        rows = rows.select(F.col("e.keys").alias("key"), F.col("e.hashes").alias("hash"), F.col("e.lens").alias("len"), "part", "at")
        return rows.join(_handed(self.dead(), self.content.get("gone", 0)), ["part", "at"], "left_anti")


def _schema(key_type: str) -> str:
    return f"part long, bucket int, term string, n int, ranges array<int>, max_tfs array<long>, min_lens array<long>, at array<int>, tfs array<long>, keys array<{key_type}>, hashes array<binary>, lens array<long>"


class _Parts:
    """Parts of one task: gathers documents and postings, and gives a part's rows when it is full."""

    def __init__(self, first: int, range_: int, buckets: int):
        self.next, self.range, self.buckets = first, range_, buckets
        self._clear()

    def _clear(self) -> None:
        self.docs, self.pairs = 0, 0
        self.keys, self.hashes, self.names, self.held = [], [], [], []

    def add(self, keys: pa.Array, hashes: pa.Array, found: list[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]) -> None:
        """Documents, and their postings (rows, codes, words, tf)."""
        for rows, codes, names, tf in found:
            self.held.append(((rows + self.docs).astype(np.int32), (codes + sum(map(len, self.names))).astype(np.int32), tf))
            self.names.append(names.cast(pa.large_string()))
            self.pairs += len(rows)
        self.keys.append(keys)
        self.hashes.append(hashes)
        self.docs += len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """The rows of what was gathered: that of the documents, then the terms' by bucket and term."""
        if not self.docs:
            return
        whole = lambda i, t: np.concatenate([x[i] for x in self.held]).astype(t) if self.held else np.zeros(0, t)
        at, codes, tf = whole(0, np.int32), whole(1, np.int32), whole(2, np.int64)
        self.held = []
        names = pa.chunked_array(self.names, pa.large_string()).combine_chunks().dictionary_encode()
        bucket = np.fromiter((zlib.crc32(t) % self.buckets for t in names.dictionary.cast(pa.large_binary()).to_pylist()), np.int64, len(names.dictionary))
        rank = np.empty(len(names.dictionary), np.int64)
        order = np.asarray(pc.array_sort_indices(names.dictionary), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        rank[order] = np.arange(len(order))
        # a document's fields are added up
        pairs, same = np.unique(rank[np.asarray(names.indices, np.int64)[codes]] * self.docs + at, return_inverse=True)
        tf = np.bincount(same, tf, len(pairs)).astype(np.int64)
        codes, at = pairs // self.docs, pairs % self.docs
        lens = np.bincount(at, tf, self.docs).astype(np.int64)
        terms, begins, n = np.unique(codes, return_index=True, return_counts=True)
        local = at // self.range
        spots = np.flatnonzero(np.append(True, (np.diff(codes) != 0) | (np.diff(local) != 0)))[: len(pairs)]
        most, least = (np.maximum.reduceat(tf, spots), np.minimum.reduceat(lens[at], spots)) if len(spots) else (tf, tf)
        cut = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        ends = np.append(begins, len(pairs))
        part = self.next
        made = {"part": pa.array(np.full(len(terms), part)), "bucket": pa.array(bucket[order[terms]], pa.int32()), "term": names.dictionary.take(pa.array(order[terms])).cast(pa.string()), "n": pa.array(n, pa.int32())}
        made |= {name: cut(pa.array(x, t), np.searchsorted(spots, ends)) for name, x, t in (("ranges", local[spots], pa.int32()), ("max_tfs", most, pa.int64()), ("min_lens", least, pa.int64()))}
        made |= {"at": cut(pa.array(at, pa.int32()), ends), "tfs": cut(pa.array(tf), ends)}
        own = {"part": pa.array([part]), "bucket": pa.array([DOCS], pa.int32()), "keys": cut(pa.concat_arrays(self.keys), [0, self.docs]), "hashes": cut(pa.concat_arrays(self.hashes).cast(pa.binary()), [0, self.docs]), "lens": cut(pa.array(lens), [0, self.docs])}
        self.next += 1
        self._clear()
        kinds = {k: c.type for k, c in (made | own).items()}
        for x, size in ((own, 1), (made, len(terms))):
            yield pa.RecordBatch.from_arrays([x.get(k, pa.nulls(size, t)) for k, t in kinds.items()], names=list(kinds))


def _first_part(number: int, group: int) -> int:
    """The first of a task's or group's parts in a segment; ranges, ``PER_PART`` to a part, stay below 2^63."""
    return (number << 42) + (group << 20)


def _scanned(index: Index, rows: DataFrame, weights: dict[str, int]) -> DataFrame:
    """The rows of the next segment, of documents (key, hash and lower-case text fields)."""
    fields, size, pairs = list(weights), index.range * PER_PART, MOST_PAIRS
    number, range_, buckets = index.version + 1, index.range, index.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = None
        for b in words.slices(batches, fields):
            parts = parts or _Parts(_first_part(number, TaskContext.get().partitionId()), range_, buckets)
            while len(b):
                own, b = b.slice(0, size - parts.docs), b.slice(size - parts.docs)
                found = [words.terms(own.column(f), T.BREAKS) for f in fields]
                parts.add(own.column("key"), own.column("hash"), [(*x[:3], x[3] * weights[f]) for f, x in zip(fields, found, strict=True)])
                if parts.docs == size or parts.pairs >= pairs:
                    yield from parts.rows()
        if parts:
            yield from parts.rows()
        trim()

    return rows.mapInArrow(run, _schema(rows.schema["key"].dataType.simpleString()))


def _write_segment(index: Index, rows: DataFrame) -> tuple[str | None, int, int, int]:
    """Writes a segment's rows; its name, None if it has no documents, and how many documents, documents with terms, and tokens it has."""
    name = uuid.uuid4().hex
    rows.write.option("compression", "zstd").option("parquet.page.row.count.limit", PAGE).parquet(f"{index.path}/parts/{name}")
    made = index._read([f"parts/{name}"], _schema(index.key_type)).where(F.col("bucket") == DOCS).select(F.explode("lens").alias("len"))
    n = made.agg(F.count("*").alias("docs"), F.count_if(F.col("len") > 0).alias("held"), F.coalesce(F.sum("len"), F.lit(0)).alias("tokens")).first()
    return name if n.docs else None, n.docs, n.held, n.tokens


def update(spark: SparkSession, path: str, docs: DataFrame, weights: dict[str, int] | None = None, expect: int | None = None) -> dict[str, int]:
    """Brings the index to ``docs`` (key and text fields, as for ``search.postings``); counts of added, changed, removed and same documents.

    ``expect`` is the version that ``docs`` go on from (the newest, if not given); if there is a later one, ``LostRace`` is raised and nothing has changed.
    """
    index = Index(spark, path, expect)
    weights = {f: w for f, w in (weights or search.FIELD_WEIGHTS).items() if f in docs.columns}
    docs = docs.where(F.col("key").isNotNull())
    index.key_type = index.content.get("key_type", docs.schema["key"].dataType.simpleString())
    digest = F.unhex(F.sha2(F.to_json(F.struct(*(F.col(f) for f in weights))), 256))
    rows = docs.select("key", digest.alias("hash"), *(T.lowered(F.col(f)).alias(f) for f in weights))
    content = {"segments": list(index.segments), "dead": list(index.content.get("dead", [])), "lost": list(index.content.get("lost", [])), "key_type": index.key_type, "range": index.range, "buckets": index.buckets}
    content |= {k: index.content.get(k, 0) for k in ("docs", "tokens", "gone")}
    counts = {"added": 0, "changed": 0, "removed": 0, "same": 0}
    gone = None
    if index.segments:
        before = index.docs().select(F.col("key").alias("old_key"), F.col("hash").alias("old"), "part", "at", "len")
        state = F.when(F.col("old_key").isNull(), "added").when(F.col("key").isNull(), "removed").when(F.col("hash") == F.col("old"), "same").otherwise("changed")
        states = docs.select("key", digest.alias("hash")).join(before, F.col("key") == F.col("old_key"), "full")
        states = written(states.select("key", "part", "at", "len", state.alias("state")))
        counts |= {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
        if not (counts["added"] + counts["changed"] + counts["removed"]):
            return counts
        new = states.where("state in ('added', 'changed')").select("key")
        # texts move only if the keys of the new are too many for a task
        chars = new.agg(F.coalesce(F.sum(F.length(F.col("key").cast("string"))), F.lit(0)).alias("n")).first().n
        rows = rows.join(F.broadcast(new) if chars <= FEW_CHARS else new, "key", "left_semi")
        gone = states.where("state in ('removed', 'changed')").select("part", "at", "len")
    made, added, held, tokens = _write_segment(index, _scanned(index, rows, weights))
    if not index.segments:
        counts["added"] = added
        if index.version and not added:
            return counts
    if made is not None:
        content["segments"].append(made)
    content["docs"], content["tokens"] = content["docs"] + held, content["tokens"] + tokens
    if n := counts["removed"] + counts["changed"]:
        folder = uuid.uuid4().hex
        gone.select("part", "at").write.parquet(f"{index.path}/{folder}/dead")
        dead = spark.read.schema("part long, at int").parquet(f"{index.path}/{folder}/dead")
        gone_at = dead.groupBy("part").agg(F.collect_set("at").alias("ats"))
        marks = written(gone_at.select("part", F.transform(F.sequence(F.lit(0), F.array_max("ats")), lambda i: F.array_contains("ats", i)).alias("marks")))
        size = marks.agg(F.sum(F.size("marks")).alias("n")).first().n
        # of the blocks, terms and places alone are read, and no posting becomes a row
        posted = index.blocks().select("term", "part", "at").join(F.broadcast(marks) if size <= FEW_CHARS else marks, "part")
        less = posted.select("term", (-F.size(F.filter("at", lambda x: F.get("marks", x)))).cast("long").alias("df")).where("df < 0")
        less.groupBy("term").agg(F.sum("df").alias("df")).write.parquet(f"{index.path}/{folder}/lost")
        content["dead"].append(f"{folder}/dead")
        content["lost"].append(f"{folder}/lost")
        less = gone.agg(F.count_if(F.col("len") > 0).alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("len")).first()
        content |= {"docs": content["docs"] - less.n, "tokens": content["tokens"] - less.len, "gone": content["gone"] + n}
    manifest.commit(spark, index.path, index.version + 1, content)
    return counts | {"version": index.version + 1, "segments": len(content["segments"])}


def _gone(index: Index, rows: DataFrame) -> DataFrame:
    """Rows by ``part`` with ``gone``, the places of its dead documents, or null."""
    if not index.content.get("dead"):
        return rows.withColumn("gone", F.lit(None).cast("array<int>"))
    gone = index.dead().groupBy("part").agg(F.collect_list("at").alias("gone"))
    return rows.join(_handed(gone, index.content["gone"]), "part", "left")


def compact(spark: SparkSession, path: str) -> int:
    """One segment of all live documents in place of many, as a new version; from the stored postings, without the documents' texts.

    Parts are put together, in their order, to about the size of a full one; a posting moves once.
    """
    index = Index(spark, path)
    number, range_, buckets, size = index.version + 1, index.range, index.buckets, index.range * PER_PART
    parts = _gone(index, index.parts())
    live = F.array_size("keys") - F.coalesce(F.array_size("gone"), F.lit(0))
    # a row for each part: some thousands of documents
    before = F.sum("live").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    groups = written(parts.select("part", live.alias("live")).select("part", F.floor(F.coalesce(before, F.lit(0)) / size).alias("g")))
    n = groups.count()
    posted = index.blocks().join(_handed(groups, n), "part").select("g", "part", "term", "at", "tfs")
    kept = parts.join(_handed(groups, n), "part").select(F.col("g").alias("h"), "part", "keys", "hashes", "gone")
    empty = spark.createDataFrame([], _schema(index.key_type)).toArrow()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right):
            return empty
        right = right.sort_by("part")
        keys, hashes = (right[c].combine_chunks().flatten() for c in ("keys", "hashes"))
        alive, row, own, tf = _opened(right, left)
        live, names, out = np.flatnonzero(alive), left["term"].combine_chunks(), []
        place = np.cumsum(alive)[own] - 1
        made = _Parts(_first_part(number, right["h"][0].as_py()), range_, buckets)
        for begin in range(0, len(live), size):
            here, mine = pa.array(live[begin : begin + size]), np.flatnonzero((place >= begin) & (place < begin + size))
            made.add(keys.take(here), hashes.take(here), [(place[mine] - begin, row[mine], names, tf[mine])])
            out += made.rows()
        return pa.Table.from_batches(out) if out else empty

    rows = posted.groupBy("g").cogroup(kept.groupBy("h")).applyInArrow(run, _schema(index.key_type))
    made, _, held, tokens = _write_segment(index, rows)
    content = index.content | {"segments": [made] if made else [], "dead": [], "lost": [], "gone": 0, "docs": held, "tokens": tokens}
    manifest.commit(spark, index.path, number, content)
    return number


def _opened(parts: pa.Table, posts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which documents of parts (part, keys, gone), in order of ``part``, live; and of the postings of terms (part, at, tfs) in live ones the row, the document's place and the frequency."""
    owners, gone, at = np.asarray(parts["part"], np.int64), parts["gone"].combine_chunks(), posts["at"].combine_chunks()
    sizes = np.asarray(pc.list_value_length(parts["keys"].combine_chunks()), np.int64)
    starts = np.cumsum(sizes) - sizes
    alive = np.ones(int(sizes.sum()), bool)
    alive[starts[np.asarray(pc.list_parent_indices(gone), np.int64)] + np.asarray(gone.flatten(), np.int64)] = False
    row, tf = np.asarray(pc.list_parent_indices(at), np.int64), np.asarray(posts["tfs"].combine_chunks().flatten(), np.int64)
    own = starts[np.searchsorted(owners, np.asarray(posts["part"], np.int64))][row] + np.asarray(at.flatten(), np.int64)
    kept = np.flatnonzero(alive[own])
    return alive, row[kept], own[kept], tf[kept]


def _within(index: Index, asked: DataFrame) -> DataFrame:
    """Blocks of the buckets of questions' terms, so that other pages aren't read if these are few."""
    found = [r.bucket for r in asked.select("bucket").distinct().collect()]
    return index.blocks().where(F.col("bucket").isin(found)) if len(found) < index.buckets else index.blocks()


def _bounds(index: Index, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(qid, term, idf, bucket) of the questions' terms; (qid, range, bound, place) of the ranges with one of them."""
    docs, mean = F.lit(index.content["docs"]), F.lit(index.content["tokens"] / index.content["docs"])
    asked = written(questions.select("qid", F.explode(T.question_terms(F.col("text"))).alias("term")).select("qid", "term", index.bucket()))
    n = asked.count()
    names = _handed(asked.select("bucket", "term").distinct(), n)
    blocks = _within(index, asked)
    # places and frequencies aren't read
    df = blocks.join(names, ["bucket", "term"], "left_semi").select("term", F.col("n").cast("long").alias("df"))
    df = df.unionByName(index.lost().join(names, "term", "left_semi")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = written(asked.join(df, "term").select("qid", "term", idf.alias("idf"), "bucket"))
    heads = blocks.select("bucket", "term", "part", F.arrays_zip("ranges", "max_tfs", "min_lens").alias("spots")).join(_handed(asked, n), ["bucket", "term"]).select("qid", "idf", "part", F.inline("spots"))
    most = F.col("idf") * _impact(F.col("max_tfs"), F.col("min_lens"), mean)
    bounds = heads.groupBy("qid", (F.col("part") * PER_PART + F.col("ranges")).alias("range")).agg(F.sum(most).alias("bound"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "range"))
    return asked, written(bounds.withColumn("place", place))


def search_index(spark: SparkSession, path: str, questions: DataFrame, k: int = 30, first: int = FIRST, version: int | None = None) -> DataFrame:
    """(qid, key, score, rank) of questions (qid, text): the rows of ``search.text_search`` over the indexed documents."""
    index = Index(spark, path, version)
    q_type = questions.schema["qid"].dataType.simpleString()
    if not index.content.get("docs"):
        return spark.createDataFrame([], f"qid {q_type}, key {index.key_type}, score double, rank int")
    asked, bounds = _bounds(index, questions)
    tried = _scored(index, asked, bounds.where(F.col("place") <= first).select("qid", "range"), k)
    kth = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key"))
    tried = written(tried)
    least = tried.withColumn("r", kth).where(F.col("r") == k).select("qid", F.col("score").alias("least"))
    # scores are rounded to six places: a bound that is no farther off may still tie
    open_ = bounds.where(F.col("place") > first).join(least, "qid", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
    rest = _scored(index, asked, open_.select("qid", "range"), k)
    return search.topk(tried.unionByName(rest), k)


def _scored(index: Index, asked: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(qid, key, score) of the ``k`` best live documents of each question in the wanted (qid, range), and in each block of parts.

    A question meets a block of parts in one row, with its terms and the ranges that it wants there; a term's postings in a part move once, in one row and
    as places and frequencies, whatever the number of questions; the part's keys and lengths move once.
    """
    blocks = max(1, -(-index.content["docs"] // search.TEXT_BLOCK))
    dealt = F.pmod(F.xxhash64("part"), F.lit(blocks)).cast("int").alias("b")
    wanted = written(wanted.select("qid", "range", _part().alias("part")))
    ranges = written(wanted.select("part", "range").distinct().groupBy("part").agg(F.collect_list((F.col("range") % PER_PART).cast("int")).alias("open")))
    ranges, names = _handed(ranges, ranges.count()), _handed(asked.select("bucket", "term").distinct(), asked.count())
    rows = _within(index, asked).join(names, ["bucket", "term"], "left_semi").join(ranges, "part")
    inside = F.filter(F.arrays_zip("at", "tfs"), lambda x: F.array_contains("open", F.floor(x["at"] / index.range).cast("int")))
    rows = rows.select(dealt, "part", "term", inside.alias("e")).where(F.size("e") > 0).select("b", "part", "term", F.col("e.at").alias("at"), F.col("e.tfs").alias("tfs"))
    docs = _gone(index, index.parts().select("part", "keys", "lens").join(ranges, "part")).select(dealt, "part", "keys", "lens", "gone")
    terms = asked.groupBy("qid").agg(F.collect_list(F.struct("term", "idf")).alias("t"))
    spots = wanted.groupBy("qid", dealt).agg(F.collect_list("range").alias("ranges")).join(terms, "qid")
    spots = spots.select("b", "qid", "ranges", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"))
    schema = f"qid {asked.schema['qid'].dataType.simpleString()}, key {index.key_type}, score double"
    scores = _range_scores(k, index.content["tokens"] / index.content["docs"], index.range)
    return rows.unionByName(docs, allowMissingColumns=True).groupBy("b").cogroup(spots.groupBy("b")).applyInArrow(scores, schema)


def _range_scores(k: int, mean: float, range_: int):
    scores = search.block_scores(k, mean)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        docs, left = left.filter(pc.is_null(left["term"])).sort_by("part"), left.filter(pc.is_valid(left["term"]))
        keys, lens = (docs[c].combine_chunks() for c in ("keys", "lens"))
        _, row, own, tf = _opened(docs, left)
        sizes = np.asarray(pc.list_value_length(keys), np.int64)
        place = own - np.repeat(np.cumsum(sizes) - sizes, sizes)[own]
        spot = np.repeat(np.asarray(docs["part"], np.int64), sizes)[own] * PER_PART + place // range_
        ranges, terms = np.unique(spot), pc.unique(left["term"])
        at = lambda values: np.asarray(pc.fill_null(pc.index_in(values, value_set=terms), -1), np.int64)
        known = pa.array(ranges)
        rows, numbers, idfs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, (r, t, idf) in enumerate(zip(*(right[c].combine_chunks() if right.num_rows else [] for c in ("ranges", "terms", "idfs")))):
            r, t, idf = np.asarray(pc.fill_null(pc.index_in(r.values, value_set=known), -1), np.int64), at(t.values), np.asarray(idf.values, np.float64)
            r, t, idf = r[r >= 0], t[t >= 0], idf[t >= 0]
            numbers.append((r[:, None] * len(terms) + t).ravel())
            idfs.append(np.tile(idf, len(r)))
            rows.append(np.full(len(numbers[-1]), i))
        taken = pa.array(own)
        posted = pa.table({"key": keys.flatten().take(taken), "n": np.searchsorted(ranges, spot) * len(terms) + at(left["term"])[row], "tf": tf, "len": lens.flatten().take(taken)})
        return scores(posted, pa.table({"qid": right["qid"].take(pa.array(np.concatenate(rows))), "n": np.concatenate(numbers), "idf": np.concatenate(idfs)}))

    return run


def ranges_read(spark: SparkSession, path: str, questions: DataFrame, k: int = 30, first: int = FIRST) -> tuple[int, int]:
    """How many (question, range) pairs a search reads, and how many there are with a term of the question."""
    _, bounds = _bounds(Index(spark, path), questions)
    least = search_index(spark, path, questions, k, first).where(F.col("rank") == k - 1).select("qid", F.col("score").alias("least"))
    read = bounds.join(least, "qid", "left").where((F.col("place") <= first) | F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6))
    return read.count(), bounds.count()
