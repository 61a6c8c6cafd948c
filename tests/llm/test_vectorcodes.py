"""Vector codes against a plain computation in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from loomspark.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, rounds=4, entries=256):
    """One length, by the contract's words."""
    kept = [(i, [math.floor(1024 * float(np.float32(v))) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    width = len(kept[0][1]) // 4
    parts = [[x[p * width : (p + 1) * width] for _, x, _ in kept] for p in range(4)]
    seeds, seen = [], set()
    for n, (i, _, _) in sorted(enumerate(kept), key=lambda e: (e[1][0] is None, e[1][0] or 0, e[1][1])):
        if i is not None and i not in seen:
            seen.add(i)
            seeds.append(n)
    books = [[list(parts[p][n]) for n in seeds[:entries]] for p in range(4)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            own = [near(x, books[p])[1] for x in parts[p]]
            for k in set(own):
                members = [x for x, o in zip(parts[p], own) if o == k]
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    final = [[near(x, books[p]) for x in parts[p]] for p in range(4)]
    error = [sum(final[p][n][0] for p in range(4)) for n in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return [(i, "".join(f"{final[p][n][1]:02x}" for p in range(4)), error[n], by_label[label], sha) for n, (i, _, label) in enumerate(kept)]


def rows_of(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=str)


def made(n, d, seed, clusters=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * 0.2
    if clusters:
        x = rng.normal(size=(clusters, d))[rng.integers(clusters, size=n)] + x * 0.05
    return [(int(i), [float(v) for v in row], int(rng.integers(5)) if rng.random() < 0.8 else None) for i, row in zip(rng.permutation(n), x.astype(np.float32))]


@pytest.mark.parametrize("n,d,clusters", [(700, 16, None), (600, 8, 12), (40, 4, None)])
def test_equal_to_the_plain_computation(spark, n, d, clusters):
    rows = made(n, d, n, clusters)
    rows += [(9001, None, 1), (9002, [None] * d, 1), (9003, [math.nan] * d, 2), (9004, [math.inf] + [0.0] * (d - 1), None), (None, rows[0][1], 3), rows[5], rows[5]]
    # a group of copies: one vector of many rows
    rows += [(20_000 + i, rows[7][1], 4) for i in range(n // 2)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "'x' AS code", "2 AS d", "3 AS part", "4 AS error")
    assert rows_of(vectorcodes.encode(df)) == sorted(plain(rows), key=str)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(i, [float(i % 2)] * 4, 0) for i in range(10)] + [(10 + i, [0.5] * 4, 0) for i in range(300)]
    assert rows_of(vectorcodes.encode(spark.createDataFrame(rows, SCHEMA))) == sorted(plain(rows), key=str)


def test_large_components_stay_exact(spark):
    rng = random.Random(3)
    schema = "vec_id long, embedding array<double>, label string"
    for scale in (1e5, 1e12):
        rows = [(i, [rng.uniform(-scale, scale) for _ in range(4)], None) for i in range(300)]
        got = {r.vec_id: r.code for r in vectorcodes.encode(spark.createDataFrame(rows, schema)).collect()}
        ints = {i: [math.floor(1024 * v) for v in x] for i, x, _ in rows}
        books = [[ints[i][p] for i in range(256)] for p in range(4)]
        for _ in range(4):
            for p in range(4):
                groups = {}
                for x in ints.values():
                    groups.setdefault(min(range(256), key=lambda k: (abs(books[p][k] - x[p]), k)), []).append(x[p])
                for k, members in groups.items():
                    books[p][k] = sum(members) // len(members)
        for i, x in ints.items():
            assert got[i] == "".join(f"{min(range(256), key=lambda k: (abs(books[p][k] - x[p]), k)):02x}" for p in range(4))


def test_other_lengths_and_empty_tables(spark):
    rows = [(1, [], 1), (2, [0.5, 1.0, 1.5, 2.0, 2.5], None), (3, [0.5, 1.0, 1.5, 2.0], 1)]
    got = {r.vec_id: (r.code, r.error) for r in vectorcodes.encode(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ("00000000", 0), 2: ("00000000", 0), 3: ("00000000", 0)}
    assert vectorcodes.encode(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
    assert vectorcodes.encode(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shortlists_hold_every_nearest_entry():
    rng = np.random.default_rng(8)
    shorter = 0
    for _ in range(60):
        entries = rng.integers(-300, 300, (64, 3))
        x = rng.integers(-300, 300, 3) + rng.integers(-40, 40, (30, 3))
        found = vectorcodes.shortlist(x.min(0), x.max(0), x.sum(0).astype(object), len(x), entries)
        want, _ = vectorcodes.nearest(x, entries)
        assert set(want) <= set(found.tolist())
        shorter += len(found) < 40
    assert shorter > 40


def test_hilbert_neighbours_touch():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    place = vectorcodes.hilbert(points, 3)
    assert sorted(place) == list(range(512))
    walk = points[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
