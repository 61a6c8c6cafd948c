r"""Suffix-array dedup: every byte that lies in a ``WIDTH``-byte string that also starts earlier is removed.

All suffixes of a corpus are far more than what is worth sorting, so the sort is sparse:

1. Each ``WIDTH``-byte window names an anchor: the smallest hashed ``GRAM``-gram in it, the leftmost if equal. Equal windows
   name equal anchors at equal places, so windows are compared only where anchors agree. Neighbouring windows of one anchor
   form a stretch of text. Equal stretches that one task meets collapse: the earliest stands for all, the later ones are removed.
2. Dealt by anchor, a stretch whose anchor stands nowhere else is done. All others go on, whether they are equal or not.
3. Of these, the suffix that starts at the anchor is sorted by a merge sort over tasks: each task sorts its own and writes
   front-coded runs (length of the prefix common with the string before, and the rest). Runs are cut at splitters from a sample
   of fixed size and exchanged; a loser tree that keeps, for each run, how much its head has in common with the last winner
   merges them, and compares bytes only beyond what is known to be common. What is removed is read off the merged order: where neighbours share
   the anchor's gram, the least prefix shared between two of them and the bytes before their anchors say which windows they have in common.

Removed stretches meet their texts again by ``doc_id``; the mask of a text is their union.

Order is by ``doc_id`` and start. Defined results: a null or empty text has 0 bytes; a null ``doc_id`` takes no part and keeps its
text; rows with the same ``doc_id`` count as one document at the same places, so they are not copies of one another. Other
columns are not read. Texts of any length are read whole, in pieces that overlap by a window.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_columns, materialize

WIDTH, GRAM = 100, 40
PIECE = 1 << 20  # bytes that are hashed at once
SAMPLE = 4096  # strings from which splitters are taken
PAGE = 8192  # strings in a front-coded run
SMALL_GROUP = 12  # suffixes of one gram of which each two are met
_MULT = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram that starts at each place (wrapping polynomial of random byte values, then mixed)."""
    n = len(data)
    power, back = np.full(n, _MULT), np.full(n - gram + 1, _INV)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power)
    np.multiply.accumulate(back, out=back)
    power *= _BYTES[data]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(power, out=sums[1:])
    h = sums[gram:] - sums[:-gram]
    h *= back
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of each ``w`` neighbouring values, the leftmost if equal: block-wise running minima."""
    n = len(h)
    blocks = -(-n // w)
    c = np.full(blocks * w, ~np.uint64(0))
    c[:n] = h
    c = c.reshape(blocks, w) & ~np.uint64(127) | np.arange(w, dtype=np.uint64)
    after = np.minimum.accumulate(c[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    before = np.minimum.accumulate(c, axis=1).reshape(-1)
    p = np.arange(n - w + 1)
    left, right = after[p], before[w - 1 : n]
    take = left >> np.uint64(7) <= right >> np.uint64(7)
    start = np.where(take, p // w, (p + w - 1) // w) * w
    return start + (np.where(take, left, right) & np.uint64(127)).astype(np.int64)


def stretches(docs: list[tuple[int, bytes]], width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, stretch hash, doc_id, start, windows, place of the anchor in it) of each stretch of some texts."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]

    def scan(parts: list[tuple[int, int, bytes]]) -> None:
        """parts: doc_id, place of the first byte, bytes."""
        joined = b"".join(p[2] for p in parts)
        data = np.frombuffer(joined, np.uint8)
        h = gram_hashes(data, gram)
        at = anchors(h, width - gram + 1)
        size = np.array([len(p[2]) for p in parts])
        end = np.cumsum(size)
        part = np.repeat(np.arange(len(parts)), size)[: len(at)]
        ok = np.arange(len(at)) + width <= end[part]
        first = ok & np.concatenate([[True], (at[1:] != at[:-1]) | ~ok[:-1]])
        begin = np.flatnonzero(first)
        if not len(begin):
            return
        last = np.concatenate([begin[1:], [len(at)]])
        total = np.concatenate([[0], np.cumsum(ok)])
        windows = total[last] - total[begin]
        digest = xxhash.xxh3_64_intdigest
        stop = (begin + windows + width - 1).tolist()
        out[0].append(h[at[begin]].view(np.int64))
        out[1].append(np.array([digest(joined[a:b]) for a, b in zip(begin.tolist(), stop)], np.uint64).view(np.int64))
        own = part[begin]
        out[2].append(np.array([p[0] for p in parts], np.int64)[own])
        out[3].append(begin - (end - size)[own] + np.array([p[1] for p in parts], np.int64)[own])
        out[4].append(windows)
        out[5].append(at[begin] - begin)

    held, total = [], 0
    for doc_id, text in docs:
        for i in range(0, max(len(text) - width + 1, 0), PIECE):
            piece = text[i : i + PIECE + width - 1]
            held.append((doc_id, i, piece))
            total += len(piece)
            if total >= PIECE:
                scan(held)
                held, total = [], 0
    if held:
        scan(held)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unions of the byte ranges of each document."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    turn = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    base = turn * (int(stop.max()) + 1)  # one line for all documents, so that a running maximum serves each
    reach = np.maximum.accumulate(base + stop)
    new = np.concatenate([[True], base[1:] + start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], start[new], (reach - base)[last]


def itself(first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each place is that of the first of its run, which ``first`` marks: a repeated row meets its own stretches."""
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(first) else np.zeros(0, np.int64)
    return (doc == doc[lead]) & (start == start[lead])


def rows(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in columns.values()], names=list(columns))


_MET = "key long, sh long, doc_id long, start long, size long, off long"


def met(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Step 1. Candidates: anchor as ``key``, stretch hash, doc_id, start, windows, place of the anchor. Ranges that the task can already remove have ``off`` -1, and their stop as size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(i, raw(t)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None]
            kh, sh, doc, start, size, off = stretches(texts, width, gram)
            order = np.lexsort((start, doc, sh, kh))
            same = np.concatenate([[False], (kh[order][1:] == kh[order][:-1]) & (sh[order][1:] == sh[order][:-1])]) if len(order) else np.zeros(0, bool)
            gone = np.sort(order[same & ~itself(~same, doc[order], start[order])])
            keep = np.sort(order[~same])
            d, a, z = merged(doc[gone], start[gone], start[gone] + size[gone] + width - 1)
            spread = (d.view(np.uint64) * _MULT).view(np.int64)
            yield rows(key=spread, sh=a, doc_id=d, start=a, size=z, off=np.full(len(d), -1))
            yield rows(key=kh[keep], sh=sh[keep], doc_id=doc[keep], start=start[keep], size=size[keep], off=off[keep])

    return docs.select("doc_id", "text").mapInArrow(run, _MET)


def dealt(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """Step 2. (doc_id, start, size, off): what the tasks removed, with ``off`` -1 and the stop as size, and the stretches that go on: those whose anchor stands elsewhere too."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartition(n, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # neighbours of the sorted stream tell whether an anchor stands twice; the last row waits for the next batch
        names, last, was = ("doc_id", "start", "size", "off"), None, False
        for b in batches:
            t = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("key", *names)}
            passed = t["off"] < 0
            yield rows(**{k: t[k][passed] for k in names})
            t = {k: v[~passed] if last is None else np.concatenate([last[k], v[~passed]]) for k, v in t.items()}
            if not len(t["key"]):
                continue
            same = t["key"][1:] == t["key"][:-1]
            shared = (np.concatenate([[was], same]) | np.concatenate([same, [False]]))[:-1]
            yield rows(**{k: t[k][:-1][shared] for k in names})
            last, was = {k: v[-1:] for k, v in t.items()}, bool(same[-1]) if len(same) else was
        if last is not None and was:
            yield rows(**{k: last[k] for k in names})

    return ordered.mapInArrow(run, "doc_id long, start long, size long, off long")


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, at least ``known``."""
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    near = min(n, known + 16)
    if near < n and a[known:near] == b[known:near]:
        known = near
    else:
        n = near  # the difference is close by
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - ((x.bit_length() + 7) >> 3)


_RUN = "lcp array<int>, rest binary, rest_size array<int>, before binary, before_size array<int>, doc_id array<long>, start array<long>"


def front_coded(strings: list[tuple[bytes, bytes, int, int]]) -> dict:
    """A sorted run of (suffix, bytes before it, doc_id, start) as one row."""
    out: dict[str, list] = {"lcp": [], "rest": [], "rest_size": [], "before": [], "before_size": [], "doc_id": [], "start": []}
    last = b""
    for s, before, doc, start in strings:
        k = common(last, s, 0)
        for name, v in (("lcp", k), ("rest", s[k:]), ("rest_size", len(s) - k), ("before", before), ("before_size", len(before)), ("doc_id", doc), ("start", start)):
            out[name].append(v)
        last = s
    return out | {"rest": b"".join(out["rest"]), "before": b"".join(out["before"])}


def decoded(run: dict) -> tuple[list[int], list[tuple[bytes, bytes, int, int]]]:
    strings, last, i, j = [], b"", 0, 0
    for k, n, m, doc, start in zip(run["lcp"], run["rest_size"], run["before_size"], run["doc_id"], run["start"]):
        last = last[:k] + run["rest"][i : i + n]
        strings.append((last, run["before"][j : j + m], doc, start))
        i, j = i + n, j + m
    return run["lcp"], strings


def decoded_table(t: pa.Table) -> list[tuple[list[int], list[tuple[bytes, bytes, int, int]]]]:
    """``decoded`` of all rows; numbers leave Arrow column by column."""
    columns = {}
    for name, _ in _RUN_FIELDS:
        c = t[name].combine_chunks() if isinstance(t[name], pa.ChunkedArray) else t[name]
        if pa.types.is_list(c.type):
            cut, flat = c.offsets.to_numpy().tolist(), c.values.to_numpy().tolist()
            columns[name] = [flat[a:b] for a, b in zip(cut, cut[1:])]
        else:
            columns[name] = c.to_pylist()
    return [decoded(dict(zip(columns, row))) for row in zip(*columns.values())]


def batch_of(made: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(made, schema=schema)


_INTS, _LONGS = pa.list_(pa.int32()), pa.list_(pa.int64())
_RUN_FIELDS = [("lcp", _INTS), ("rest", pa.binary()), ("rest_size", _INTS), ("before", pa.binary()), ("before_size", _INTS), ("doc_id", _LONGS), ("start", _LONGS)]


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts as compressed bytes, which is what a shuffle moves of them."""
    return map_columns(docs, ["doc_id"], ["text"], {"z": "binary"}, lambda texts: [[zstandard.compress(raw(t), 1) for t in texts]])


def runs(docs: DataFrame, unsure: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Step 3: each task's suffixes in front-coded runs of at most ``PAGE`` strings, with a few of them as sample."""
    asked = unsure.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "off")).alias("parts"))
    texts = packed(docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))).dropDuplicates(["doc_id"]).join(asked, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_RUN_FIELDS, ("sample", pa.list_(pa.binary()))])
        for b in batches:
            own = []
            for doc, z, parts in zip(b.column("doc_id").to_pylist(), b.column("z").to_pylist(), b.column("parts").to_pylist()):
                text = zstandard.decompress(z)
                for p in parts:
                    a = p["start"] + p["off"]
                    own.append((text[a : p["start"] + p["size"] + width - 1], text[p["start"] : a], doc, p["start"]))
            own.sort()
            for i in range(0, len(own), PAGE):
                page = own[i : i + PAGE]
                yield batch_of([front_coded(page) | {"sample": [s[0][:gram] for s in page[:: max(1, len(page) // 16)]]}], schema)

    return texts.select("doc_id", "z", "parts").mapInArrow(run, f"{_RUN}, sample array<binary>")


class LoserTree:
    """Merges sorted runs; each run's head carries how long a prefix it shares with the last string that was put out."""

    def __init__(self, sources: list[tuple[list[int], list[tuple]]]) -> None:
        self.sources = sources
        self.at = [0] * len(sources)
        self.h = [0] * len(sources)
        self.lost = [0] * len(sources)
        n = len(sources)
        won: dict[int, int] = {n + i: i for i in range(n)}
        for node in range(n - 1, 0, -1):
            won[node], self.lost[node] = self.play(won[2 * node], won[2 * node + 1])
        self.top = won[1] if n > 1 else 0

    def play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser keeps what it shares with the winner."""
        xs, ys = self.sources[x][1], self.sources[y][1]
        if self.at[x] >= len(xs):
            return y, x
        if self.at[y] >= len(ys):
            return x, y
        h = self.h
        if h[x] != h[y]:
            return (x, y) if h[x] > h[y] else (y, x)
        a, b = xs[self.at[x]][0], ys[self.at[y]][0]
        k = common(a, b, h[x])
        if a[k : k + 1] <= b[k : k + 1]:
            h[y] = k
            return x, y
        h[x] = k
        return y, x

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        """(length shared with the string before, string) in order."""
        n = len(self.sources)
        while n and self.at[self.top] < len(self.sources[self.top][1]):
            x = self.top
            lcps, strings = self.sources[x]
            yield self.h[x], strings[self.at[x]]
            self.at[x] += 1
            if self.at[x] < len(strings):
                self.h[x] = lcps[self.at[x]]
            node = (n + x) // 2
            while node:
                x, self.lost[node] = self.play(x, self.lost[node])
                node //= 2
            self.top = x


def order_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of some strings, and what each shares with the one before it."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    shared = [0, *(common(strings[x], strings[y], 0) for x, y in zip(order, order[1:]))]
    return np.array(order), np.array(shared)


def repeated(group: list[tuple[bytes, bytes, int, int]], shared: list[int], width: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of the windows of a group that also stand earlier, read off its merged order.

    ``shared[i]`` is the prefix that suffix ``i`` has in common with the one before. A window that begins ``b`` bytes before the
    anchor stands at two strings if the least of the shared prefixes between them is at least ``width - b`` and the bytes before their
    anchors agree for ``b``. In a small group each two strings are met; in a large one, for each ``b``, runs of suffixes and runs of the
    reversed bytes before them name the window, and all but the earliest of each name go.
    """
    # copies of one stretch: all but the earliest go whole, and the earliest stands for them
    at: dict[tuple[bytes, bytes], int] = {}
    kept: list[tuple[bytes, bytes, int, int]] = []
    between: list[int] = []
    least = 0
    for own, prefix in zip(group, shared):
        least = min(least, prefix)
        suffix, before, doc, start = own
        k = at.setdefault((suffix, before), len(kept))
        if k == len(kept):
            kept.append(own)
            between.append(least)
            least = width + len(suffix)
        elif (doc, start) != kept[k][2:]:
            doc, start = max((doc, start), kept[k][2:])
            kept[k] = suffix, before, *min(own[2:], kept[k][2:])
            yield doc, start, start + len(before) + len(suffix)
    if len(kept) > 1:
        yield from overlapping(kept, between, width)


def overlapping(group: list[tuple[bytes, bytes, int, int]], shared: list[int], width: int) -> Iterator[tuple[int, int, int]]:
    """``repeated`` of different stretches."""
    place = [(doc, start + len(before)) for _, before, doc, start in group]
    if len(group) <= SMALL_GROUP:
        for i in range(len(group)):
            least = width + len(group[i][0])
            for j in range(i + 1, len(group)):
                least = min(least, shared[j])
                if place[i] == place[j]:
                    continue
                x, y = group[i][1], group[j][1]
                back = common(x[::-1], y[::-1], 0)
                if width - least <= back:
                    doc, at = max(place[i], place[j])
                    yield doc, at - back, at + max(least, width - back)
        return
    rank = np.empty(len(group), np.int64)
    rank[sorted(range(len(group)), key=place.__getitem__)] = np.arange(len(group))
    doc, at = np.array(place).T
    size, off = np.array([len(g[0]) for g in group]), np.array([len(g[1]) for g in group])
    ahead, (order, behind) = np.array(shared), order_of([g[1][::-1] for g in group])
    for b in range(int(off.max()) + 1):
        own = np.flatnonzero((off >= b) & (size >= width - b))
        name = np.empty(len(group), np.int64)
        name[order] = np.cumsum(behind < b) if b else 0
        name = (np.cumsum(ahead < width - b) * (len(group) + 1) + name)[own]
        by = own[np.lexsort((rank[own], name))]
        name = np.sort(name)
        first = np.concatenate([[True], name[1:] != name[:-1]]) if len(by) else np.zeros(0, bool)
        for k in by[~first & ~itself(first, doc[by], at[by])].tolist():
            yield int(doc[k]), int(at[k]) - b, int(at[k]) - b + width


def edges(found: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, stop): removed ranges from the merged runs."""
    spark = found.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the sample has SAMPLE strings of GRAM bytes at most, whatever the input
    sample = sorted(bytes(r.s) for r in found.select(F.explode("sample").alias("s")).orderBy(F.xxhash64("s"), "s").limit(SAMPLE).collect())
    splits = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("range", pa.int32()), *_RUN_FIELDS])
        for b in batches:
            for _, strings in decoded_table(pa.Table.from_batches([b])):
                ends = [bisect.bisect_left(strings, (s,)) for s in splits] + [len(strings)]
                a = 0
                for k, z in enumerate(ends):
                    if z > a:
                        yield batch_of([front_coded(strings[a:z]) | {"range": k}], schema)
                    a = max(a, z)

    def merge(t: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        group: list[tuple] = []
        shared: list[int] = []
        for h, s in LoserTree(decoded_table(t)):
            if h < gram:
                if len(group) > 1:
                    out += repeated(group, shared, width)
                group, shared = [], []
            group.append(s)
            shared.append(h)
        if len(group) > 1:
            out += repeated(group, shared, width)
        d, a, z = merged(*np.array(out, np.int64).reshape(-1, 3).T)
        return pa.table({"doc_id": d, "start": a, "stop": z})

    return found.drop("sample").mapInArrow(cut, f"range int, {_RUN}").groupBy("range").applyInArrow(merge, "doc_id long, start long, stop long")


def repeated_ranges(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, stop): byte ranges to remove; those of one document may overlap."""
    first = materialize(dealt(met(docs, width, gram), width))
    sure = first.where("off < 0").select("doc_id", "start", F.col("size").alias("stop"))
    return sure.unionByName(edges(materialize(runs(docs, first.where("off >= 0"), width, gram)), width, gram))


def suffix_dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, keep_bytes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row; with ``keep_bytes`` also the bytes that stay."""
    per_doc = repeated_ranges(docs, width, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    joined = packed(docs).join(per_doc, "doc_id", "left")
    made = {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"} | ({"kept": "binary"} if keep_bytes else {})

    def run(texts: list[bytes], ranges: list) -> list[list]:
        out: list[list] = [[] for _ in made]
        for z, own in zip(texts, ranges, strict=True):
            text, spans = zstandard.decompress(z), []
            for a, b in sorted((r["start"], r["stop"]) for r in own or ()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            at = [0, *(x for s in spans for x in s), len(text)]
            kept = b"".join(text[at[i] : at[i + 1]] for i in range(0, len(at), 2))
            for col, v in zip(out, [len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if keep_bytes else [])], strict=True):
                col.append(v)
        return out

    return map_columns(joined, ["doc_id"], ["z", "ranges"], made, run)
