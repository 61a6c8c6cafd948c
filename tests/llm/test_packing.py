"""Packing: tokens against the library, the reduction against all packings of small instances, places against brute force."""

import functools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from loomspark.llm import packing
from loomspark.llm.common import materialize

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


@functools.cache
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def plain_ids(text):
    t = library()
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def fewest(items, capacity):
    """The least number of sequences, by trying all packings."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [r - items[i] * (j == k) for j, r in enumerate(rooms)])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


def test_the_reduction_never_costs_a_sequence():
    rng = random.Random(4)
    fixed_some = 0
    for _ in range(400):
        capacity = rng.randrange(8, 40)
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 10))]
        fixed, left = packing.reduced(Counter(items), capacity)
        rest = [n for n, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + fewest(rest, capacity) == fewest(items, capacity), items
        assert Counter(items) == Counter({n: c for n, c in left.items()}) + Counter(n for content, t in fixed for n in content for _ in range(t))
        fixed_some += bool(fixed)
    assert fixed_some > 300


def test_each_rule():
    assert packing.dominating(9, {5: 2}, 10) == (9,)
    assert packing.dominating(6, {4: 1, 3: 9}, 10) == (6, 4)
    # 5 beside 3 and 2 is as long as 5 can get; 4 alone would leave room
    assert packing.dominating(5, {4: 1, 3: 1, 2: 1}, 10) == (5, 4) or packing.largest_sum([2, 3, 4], {4: 1, 3: 1, 2: 1}, 5) == 5
    assert packing.dominating(20, {9: 1, 8: 1, 7: 3}, 36) == (20, 9, 7)
    # three fit beside it: no proof
    assert packing.dominating(50, {30: 1, 14: 1, 13: 3}, 100) is None


def test_best_fit_is_that_of_single_pieces():
    rng = random.Random(5)
    for _ in range(200):
        capacity = rng.randrange(5, 60)
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 60))), reverse=True)
        rooms = []
        for n in items:
            at = min((k for k, r in enumerate(rooms) if r >= n), key=lambda k: rooms[k], default=None)
            if at is None:
                rooms.append(capacity - n)
            else:
                rooms[at] -= n
        got = packing.best_fit(Counter(items), capacity)
        assert sum(t for _, t in got) == len(rooms)
        assert sorted(capacity - sum(c) for c, t in got for _ in range(t)) == sorted(rooms)


def holds(rows, capacity):
    """Every sequence is gapless from 0 and not too long; returns how many there are."""
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(of)


def test_documents_against_the_library(spark):
    rng = random.Random(6)
    words = ["The", "straße", "naïve", "don't", "x1y2", "<|endoftext|>", "été", "日本語", "🙂🙂", "ΣΑΣ", "İst", "a\x1cb", "…", "W" * 90]
    texts = ["", None, " \n\t ", "\x1c", "a\xa0b c", *(" ".join(rng.choices(words, k=rng.randrange(1, 900))) for _ in range(25))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3]), (7, texts[7])]
    df = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS length", "2 AS sequence_id", "'x' AS ids")
    rows = packing.pack_documents(df, PATH, 512).collect()
    want = []
    for doc, text in docs:
        ids = plain_ids(text)
        for piece, at in enumerate(range(0, len(ids), 512)):
            own = np.array(ids[at : at + 512], "<u4")
            want.append((doc, piece, at, len(own), zlib.crc32(own.tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    count = holds(rows, 512)
    assert count <= -(-sum(w[3] for w in want) // 512) + 2


def test_long_texts_are_read_in_stretches():
    text = "un deux\ntrois " * 400 + "y" * 700 + " fin"
    assert "".join(packing.stretches(text, 64)) == text
    assert all(len(s) <= 64 or "y" in s for s in packing.stretches(text, 64))
    packing._words.forget()
    assert packing.token_bytes(packing._tokenizer(PATH), text) == np.array(plain_ids(text)[:-1], "<u4").tobytes()


def test_latin_words_from_their_runs():
    """Every letter of the fast way, and words of mixed runs, against the library."""
    rng = random.Random(9)
    letters = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250))]
    words = [*letters, *("a" + c + "B" for c in letters), *("".join(rng.choices(letters, k=rng.randrange(1, 12))) for _ in range(3000)), "It's", "I'LL", "x'd've", "1²½"]
    known = {}
    packing._learn(packing._tokenizer(PATH), words, known)
    assert all(known[w] == np.array(plain_ids(w)[:-1], "<u4").tobytes() for w in words)


def test_a_full_memory_forgets_nothing_that_matters(monkeypatch):
    monkeypatch.setattr(packing, "WORDS", 10)
    packing._words.forget()
    text = " ".join(f"w{i} common" for i in range(50))
    assert packing.token_bytes(packing._tokenizer(PATH), text) == np.array(plain_ids(text)[:-1], "<u4").tobytes()


@pytest.mark.parametrize("bucket", [7, 20_000])
def test_a_hot_length_is_numbered_in_parts(spark, monkeypatch, bucket):
    monkeypatch.setattr(packing, "BUCKET", bucket)
    rng = random.Random(7)
    lengths = [1] * 300 + [rng.randrange(1, 65) for _ in range(300)]
    pieces = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.PIECE)
    rows = packing.pack(materialize(pieces), 64).collect()
    assert sorted((r.doc_id, r.length) for r in rows) == list(enumerate(lengths))
    assert holds(rows, 64) <= -(-sum(lengths) // 64) + 1


def test_sequences_hold_the_ids(spark):
    docs = [(i, f"document {i} " * (i + 1)) for i in range(12)]
    packed = packing.pack(materialize(packing.tokenized(spark.createDataFrame(docs, DOCS), PATH, 64, keep_ids=True)), 64)
    placed = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for doc, text in docs:
        own = sorted((r.start, placed[r.sequence_id][r.offset : r.offset + r.length]) for r in packed.where(f"doc_id = {doc}").collect())
        assert [t for _, ids in own for t in ids] == plain_ids(text)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).collect() == []
