"""Packing documents into sequences of at most ``capacity`` tokens, as few as it can.

Only lengths decide what fits, so the instance is the histogram of piece lengths: ``capacity`` numbers at most, whatever the size of the corpus.
On it the driver runs Martello and Toth's reduction: for the longest piece left it looks for a small set that provably dominates
every other set with that piece, that is, each of the others can be put, part by part, in the place of one of the set's own pieces:

1. no other piece fits beside it: it stays alone;
2. the longest piece that fits beside it is as long as the largest sum of pieces that fits: these two (whatever stood there fits in its place);
3. at most two pieces fit beside it, and no two pieces above ``b`` do, where ``b`` is the longest that fits beside it and the longest: these three.

Such a set is fixed for good, as often as its pieces last, and the instance shrinks; pieces without such a set wait, and may still go with a later one.
What remains is packed best-fit, longest first, by classes of equal room. The result is a table of runs (length, first rank, sequence, offset), a few
thousand rows by the number of lengths; tasks look up each piece's rank among those of its length in it.

Ranks are dealt by buckets of hashes, so that a length which a third of all pieces have is numbered in many tasks. Tokens are met once, in the tasks
that read the texts: a word's ids don't depend on its neighbours, so they are remembered, up to ``WORDS`` words; new words consist mostly of known runs of letters.

Defined results: a null or empty text has the closing id alone; rows without a doc_id and repeated rows are documents like any other; an empty table gives
an empty result; other columns are not read. A very long text is read a stretch at a time. Which of several pieces of one length goes where is decided by
hashes, so reruns agree.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import RELEASED, materialize, release_old

CAPACITY, CLOSING = 2048, 0
#: Words remembered in a worker, words encoded at once, characters of a word that is remembered, and of a stretch of a text.
WORDS, TOGETHER, LONG_WORD, STRETCH = 500_000, 50, 64, 1 << 20
#: Pieces of a bucket in which ranks are given.
BUCKET = 20_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words of ASCII and Latin letters, which no normal form changes; the tokenizer's own runs in them; and what it writes for each byte: printable ones themselves.
_LATIN = re.compile("[!-~¡-įı-ſ]+")
_RUN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ſ]+|[0-9²³¹¼-¾]|[^a-z0-9ªµºß-öø-ſ²³¹¼-¾]+")
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_WRITTEN = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - _PRINTABLE))}
#: What str.split takes for white space and the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are text
    return made


class _Memory:
    """Ids of words, little-endian unsigned 32-bit. When ``WORDS`` are held they go one generation back, from where words that come again are taken."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def unknown(self, words: set[str]) -> list[str]:
        """Those of ``words`` that aren't held; the others are in ``now`` afterwards."""
        fresh = words.difference(self.now)
        if len(self.now) + len(fresh) > WORDS:
            self.now, self.before, fresh = {}, self.now, words
        new = []
        for w in fresh:
            if w in self.before:
                self.now[w] = self.before[w]
            else:
                new.append(w)
        return new


#: Of words as they stand in texts, and of the lower-case runs that they consist of.
_words, _runs = _Memory(), _Memory()
RELEASED.append(_words.forget)
RELEASED.append(_runs.forget)
RELEASED.append(_tokenizer.cache_clear)


def _learn(tokenizer, new: list[str], known: dict[str, bytes]) -> None:
    """Ids of ``new`` words. Latin words are put together from their runs; the others are joined by spaces and told apart by their tokens' places."""
    model, others, mixed = tokenizer.model, [], {}
    for word in new:
        if _LATIN.fullmatch(word):
            mixed[word] = _RUN.findall(word.lower())
        else:
            others.append(word)
    for run in _runs.unknown({r for runs in mixed.values() for r in runs}):
        ids = [t.id for t in model.tokenize(run.encode().decode("latin-1").translate(_WRITTEN))]
        _runs.now[run] = struct.pack(f"<{len(ids)}I", *ids)
    for word, runs in mixed.items():
        known[word] = _runs.now[runs[0]] if len(runs) == 1 else b"".join([_runs.now[r] for r in runs])
    parts = [others[i : i + TOGETHER] for i in range(0, len(others), TOGETHER)]
    for part, made in zip(parts, tokenizer.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
        raw = np.array(made.ids, "<u4").tobytes()
        begins = np.fromiter((o[0] for o in made.offsets), np.int64, len(made.ids))
        ends = np.cumsum(np.fromiter((len(w) + 1 for w in part), np.int64, len(part)))
        at = 0
        for word, to in zip(part, (4 * np.searchsorted(begins, ends)).tolist(), strict=True):
            known[word] = raw[at:to]
            at = to


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at spaces or line ends only."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut <= at:
            ends = [e for e in (text.find(" ", at + size), text.find("\n", at + size)) if e >= 0]
            cut = min(ends, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def token_bytes(tokenizer, text: str | None) -> bytes:
    """The ids of a whole text, little-endian unsigned 32-bit, without the closing one."""
    out = []
    for part in stretches(text or ""):
        # lower case is the tokenizer's own first step; of ASCII it is the same one
        part = part.lower() if part.isascii() else part
        words = re.findall(r"[^ \t\n\r\x0b\x0c]+", part) if _SEPARATORS.search(part) else part.split()
        new = [w for w in _words.unknown(set(words)) if len(w) <= LONG_WORD]
        known = _words.now
        if new:
            _learn(tokenizer, new, known)
        try:
            out.append(b"".join(map(known.__getitem__, words)))
        except KeyError:  # a word too long to be remembered
            own: dict[str, bytes] = {}
            _learn(tokenizer, [w for w in set(words) if len(w) > LONG_WORD], own)
            out.append(b"".join([known[w] if len(w) <= LONG_WORD else own[w] for w in words]))
    return b"".join(out)


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, closing: int = CLOSING, keep_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) of documents (doc_id, text); with ``keep_ids`` their ids too (binary, little-endian)."""
    end = np.array([closing], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_old()
        tokenizer = _tokenizer(path)
        for b in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = token_bytes(tokenizer, text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for c, v in zip(columns, (doc, piece, at // 4, len(own) // 4, zlib.crc32(own), own if keep_ids else None)):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")[: 6 if keep_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)][: len(names)], names=list(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE + (", ids binary" if keep_ids else ""))


def largest_sum(lengths: list[int], left: dict[int, int], room: int) -> int:
    """The largest sum of pieces, of those ``left``, that is at most ``room``: a bit for each sum that can be reached."""
    reached, mask = 1, (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        count, step = min(left[n], room // n), 1
        while count:
            take = min(step, count)
            reached |= (reached << (n * take)) & mask
            count -= take
            step *= 2
    return reached.bit_length() - 1


def dominating(j: int, left: dict[int, int], capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of length ``j`` that dominates all others with it, by the three rules above, or None. ``left`` doesn't count that piece."""
    room = capacity - j
    fit = sorted(n for n, count in left.items() if count and n <= room)
    if not fit:
        return (j,)
    k = fit[-1]
    if k == room or k == largest_sum(fit, left, room):
        return (j, k)
    least = []
    for n in fit:
        least += [n] * min(3 - len(least), left[n])
        if len(least) == 3:
            break
    if len(least) == 3 and sum(least) <= room:
        return None
    beside = [n for n in fit if n <= room - k and left[n] > (n == k)]
    if not beside:
        return None
    b = beside[-1]
    above = []
    for n in fit:
        if n > b:
            above += [n] * min(2 - len(above), left[n])
        if len(above) == 2:
            break
    return (j, k, b) if len(above) < 2 or sum(above) > room else None


def reduced(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed sets with how often each, and the histogram of what is left."""
    left, fixed = {n: c for n, c in histogram.items() if c > 0}, []
    for j in sorted(left, reverse=True):
        while left.get(j):
            left[j] -= 1
            found = dominating(j, left, capacity)
            left[j] += 1
            if found is None:
                break
            # the rule goes on to hold while its pieces last: less is left to compete with them
            need = {n: found.count(n) for n in found}
            times = min(left[n] // c for n, c in need.items())
            fixed.append((found, times))
            for n, c in need.items():
                left[n] -= c * times
    return fixed, {n: c for n, c in left.items() if c}


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first: each piece goes where the least room that takes it is left. Sequences of equal room and content are one class."""
    classes: dict[int, dict[tuple[int, ...], int]] = {}

    def put(n: int, many: int, room: int, content: tuple[int, ...], available: int) -> tuple[int, int]:
        """Fills sequences of one class one after the other, as best-fit does; (pieces placed, sequences used)."""
        each = room // n
        full = min(many // each, available)
        rest = min(each, many - full * each) if full < available else 0
        for times, took in ((full, each), (1 if rest else 0, rest)):
            if times:
                own = classes.setdefault(room - took * n, {})
                key = content + (n,) * took
                own[key] = own.get(key, 0) + times
        return full * each + rest, full + (1 if rest else 0)

    for n in sorted(left, reverse=True):
        many = left[n]
        for room in sorted(r for r in classes if r >= n):
            for content in sorted(classes[room]):
                if not many:
                    break
                placed, used = put(n, many, room, content, classes[room][content])
                many -= placed
                classes[room][content] -= used
                if not classes[room][content]:
                    del classes[room][content]
        if many:
            put(n, many, capacity, (), -(-many // (capacity // n)))
    return [(content, times) for own in classes.values() for content, times in own.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), by length and rank: from its first rank on, each next piece of a length goes to the next sequence."""
    fixed, left = reduced(histogram, capacity)
    given, rows, sequence = dict.fromkeys(histogram, 0), [], 0
    for content, times in [*fixed, *best_fit(left, capacity)]:
        offset = 0
        for n in content:
            rows.append((n, given[n], sequence, offset))
            given[n] += times
            offset += n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset; lengths are 1 to ``capacity``.

    ``pieces`` are read three times: write them first. The histogram, of at most ``capacity`` rows, is all that comes to the driver.
    """
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(histogram, capacity)
    parts = {n: -(-c // BUCKET) for n, c in histogram.items()}
    count = F.lit(1)
    if hot := {n: c for n, c in parts.items() if c > 1}:
        table = F.create_map(*(F.lit(v) for pair in hot.items() for v in pair))
        count = F.coalesce(F.try_element_at(table, F.col("length").cast("int")), F.lit(1))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id()), count)
    dealt = materialize(pieces.withColumn("_bucket", bucket))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("n")
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(order) - 1).join(sizes.select("length", "_bucket", before.alias("_before")), ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", (F.col("_rank") + F.col("_before")).cast("long")).drop("_bucket", "_before")
    # length in the high bits, rank in the low ones: one sorted column to look up
    keys = (runs[:, 0] << 48) + runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = (np.asarray(b.column("length"), np.int64) << 48) + np.asarray(b.column("_rank"), np.int64)
            run = runs[np.searchsorted(keys, own, "right") - 1]
            kept = [c for c in b.schema.names if c != "_rank"]
            sequence = run[:, 2] + np.asarray(b.column("_rank"), np.int64) - run[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sequence), pa.array(run[:, 3])], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long").select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of documents (doc_id, text)."""
    return pack(materialize(tokenized(docs, path, capacity)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, of pieces that kept theirs. A sequence holds ``capacity`` tokens at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    raw = packed.groupBy("sequence_id").agg(F.transform(parts, lambda p: p["ids"]).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.frombuffer(b"".join(p), "<u4").astype(np.int32) for p in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(rows, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    return raw.mapInArrow(joined, "sequence_id long, ids array<int>")
