"""Words of texts by whole Arrow batches: cut at bytes, counted in the row they stand in."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T

#: Bytes of text that are cut at once; a longer text is cut by itself.
SLICE = 1 << 22


def cut(texts: pa.Array, breaks: str) -> tuple[np.ndarray, pa.Array]:
    """(rows, words): what stands between any of ``breaks``, in order, each with the row of its text. Null texts have no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    kind = np.zeros(256, bool)
    kind[[ord(c) for c in breaks if c.isascii()]] = True
    gap = kind[data]
    for c in (c.encode() for c in breaks if not c.isascii()):
        begin = np.flatnonzero(data == c[0])
        for i in range(1, len(c)):
            begin = begin[data[np.minimum(begin + i, len(data) - 1)] == c[i]]
        for i in range(len(c)):
            gap[begin + i] = True
    opens = np.ones(len(data), bool)
    opens[1:] = gap[:-1]
    opens[at[:-1][at[:-1] < len(data)]] = True
    letters = np.flatnonzero(~gap)
    first = np.flatnonzero(opens[letters])
    ends = np.append(first, len(letters)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[letters]))
    return np.searchsorted(at, letters[first], "right") - 1, words


def slices(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, in order, about ``SLICE`` bytes of the ``fields`` at a time."""
    for b in batches:
        size = sum(np.asarray(pc.fill_null(pc.binary_length(b.column(f)), 0), np.int64) for f in fields)
        part = np.cumsum(size) // SLICE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(b)]
        for begin, end in zip(edges, edges[1:], strict=False):
            if end > begin:
                yield b.slice(begin, end - begin)


def is_term(words: pa.Array) -> np.ndarray:
    """As ``text.is_term``."""
    return np.asarray(pc.and_(pc.greater_equal(pc.utf8_length(words), 2), pc.invert(pc.is_in(words, value_set=pa.array(T.STOP_WORDS, words.type)))))


def _distinct(texts: pa.Array, breaks: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(rows, codes, words): words by their numbers among the distinct ones."""
    rows, words = cut(texts, breaks)
    words = words.dictionary_encode()
    return rows, np.asarray(words.indices, np.int64), words.dictionary


def terms(texts: pa.Array, breaks: str) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(rows, codes, words, tf): how often each text holds each of its terms, by the terms' numbers among the distinct words."""
    rows, codes, found = _distinct(texts, breaks)
    kept = is_term(found)[codes]
    width = max(1, len(found))
    pairs, tf = np.unique(rows[kept] * width + codes[kept], return_counts=True)
    return pairs // width, pairs % width, found, tf.astype(np.int64)


def counts(df: DataFrame, texts: dict[str, Column], breaks: str, weights: dict[str, int], asked: dict[str, int] | None = None, rest: int | None = None, terms: bool = True) -> DataFrame:
    """(key, term, tf), or (key, n, tf) by the numbers of the ``asked`` terms: how often a row's ``texts`` hold a word, times the field's weight.

    A row of ``df`` gives a row for each field and distinct word; all words not ``asked`` for count as ``rest``, if it is given, else not at all. With
    ``terms`` only terms count.
    """
    key, fields = df.schema["key"].dataType.simpleString(), list(texts)
    names, numbers = (None, None) if asked is None else (pa.array(list(asked), pa.large_string()), np.array([*asked.values(), -1 if rest is None else rest], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, fields):
            for f in fields:
                rows, codes, words = _distinct(b.column(f), breaks)
                counted = is_term(words) if terms else np.ones(len(words), bool)
                # places among the asked terms, the last for all others
                place = np.arange(len(words)) if names is None else np.asarray(pc.fill_null(pc.index_in(words, value_set=names), len(names)), np.int64)
                if names is not None and rest is None:
                    counted = counted & (place < len(names))
                kept = counted[codes]
                width = len(words) + 1 if names is None else len(names) + 1
                pairs, tf = np.unique(rows[kept] * width + place[codes[kept]], return_counts=True)
                found = pa.array(pairs % width)
                what = words.take(found).cast(pa.string()) if names is None else pa.array(numbers[pairs % width])
                yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(pairs // width)), what, pa.array(tf.astype(np.int64) * weights[f])], names=["key", "n" if names is not None else "term", "tf"])

    return df.select("key", *(c.alias(f) for f, c in texts.items())).mapInArrow(run, f"key {key}, {'term string' if names is None else 'n long'}, tf long")


def buckets(df: DataFrame, text: Column, dim: int) -> DataFrame:
    """(key, vec): how many of a row's terms fall into each of ``dim`` buckets, picked by their MD5; rows without terms are left out."""
    key = df.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, ["text"]):
            rows, codes, words = _distinct(b.column("text"), T.BREAKS)
            own = np.fromiter((int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[:4], "big") % dim for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words))
            kept = is_term(words)[codes]
            n = np.bincount(rows[kept] * dim + own[codes[kept]], minlength=len(b) * dim).reshape(-1, dim)
            held = np.flatnonzero(n.any(axis=1))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * dim), pa.array(n[held].ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(held)), vec], names=["key", "vec"])

    return df.select("key", text.alias("text")).mapInArrow(run, f"key {key}, vec array<int>")
