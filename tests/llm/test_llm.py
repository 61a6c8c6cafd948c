"""The ten operators against brute force, and on nulls, empty texts and tables, repeats and clashing columns."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from loomspark.llm import ann, bpe, htmltree, langid, licenses, linededup, mixing, quality, simhash, suffixes
from loomspark.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, h string, hot string, fp string"
LONG = "The quick brown fox jumps over the lazy dog by the river bank"


def documents():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    texts = [None, "", " \n\t", "x", LONG, LONG.upper(), f"  {LONG}\n{LONG}"] + [f"{LONG}\n" + " ".join(word() for _ in range(80)) for _ in range(8)]
    base = " ".join(word() for _ in range(200))
    texts += [base, base, base + " end", "start " + base, base[:300] + "~" + base[300:], " ".join(word() for _ in range(20_000))]
    return [(i, t, "en" if i % 3 else None, [None, "a", "b"][i % 3], None, "x", "y", "z", "w") for i, t in enumerate(texts)] + [(None, base, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_line_dedup(docs, empty):
    got = {r.doc_id: r for r in linededup.line_dedup(docs).collect()}
    held = {}
    rows = [(i, t) for i, t, *_ in documents() if i is not None]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert linededup.line_dedup(empty).count() == 0


def test_simhash(docs, empty):
    def brute(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(i, brute(t)) for i, t, *_ in documents() if i is not None]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert {i: (f, find(i)) for i, f in rows} == {k: v for k, v in got.items() if k is not None}
    assert got[None][1] is None
    assert simhash.simhash_components(empty).count() == 0


def test_trie_pairs():
    rng = np.random.default_rng(1)
    fp = np.unique((rng.integers(0, 1 << 20, 600).astype(np.uint64) << np.uint64(44)) >> np.uint64(36))
    x, y = simhash.trie_pairs(np.zeros(len(fp), np.int64), fp, 2)
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())} == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[100] == 100


@pytest.mark.parametrize("piece", [1 << 20, 300])
def test_suffixes(docs, empty, piece, monkeypatch):
    got = {r.doc_id: r for r in suffixes.suffix_dedup(docs, keep_bytes=True).collect()}
    seen = set()
    for i, t, *_ in sorted((r for r in documents() if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        assert bytes(got[i].kept) == np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert got[i].n_removed == gone.sum() and got[i].kept_sha256 == hashlib.sha256(bytes(got[i].kept)).hexdigest()
    assert got[None].n_removed == 0
    monkeypatch.setattr(suffixes, "PIECE", piece)
    data = [(1, b"ab" * 400 + bytes(range(256)) * 3)]
    whole = suffixes.stretches(data, 100, 40)
    assert whole[4].sum() == len(data[0][1]) - 99
    assert suffixes.suffix_dedup(empty).count() == 0


def test_loser_tree():
    rng = random.Random(2)
    runs, all_ = [], []
    for _ in range(7):
        s = sorted((bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))), b"", 0, 0) for _ in range(rng.randint(0, 30)))
        all_ += s
        runs.append(suffixes.decoded(suffixes.front_coded(s)))
    out = list(suffixes.LoserTree(runs))
    assert [s[0] for _, s in out] == sorted(s[0] for s in all_)
    assert all(h == suffixes.common(a[0], b[0], 0) for (_, a), (h, b) in zip(out, out[1:]))


def test_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.Codec(ranks, public_tokenizers.PATTERN)
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice("abcdeE éßçñ中文字🙂\n\t  '\"#$%123٣²½\x1c\x85 _-'re'll") for _ in range(rng.randint(0, 60)))
        ids, named = c.encode(t)
        assert ids == enc.encode_ordinary(t) and c.decode(ids) == t.encode() and named == ",".join(map(str, ids))
    for r in bpe.round_trip(docs, path, public_tokenizers.PATTERN, ids=True).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == enc.encode_ordinary(r.text or "") and r.decoded == (r.text or "")
    assert bpe.round_trip(empty, path, public_tokenizers.PATTERN).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix(docs.withColumn("sources", F.array("source"))).collect()
    sizes, taken, target = {}, {}, {}
    for r in out:
        s = r.sources[0]
        sizes[s], taken[s] = sizes.get(s, 0) + r["size"], taken.get(s, 0) + r.taken
        target[s] = r.target
        assert r.taken in (0, r["size"], 2 * r["size"])
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-6
    assert all(t <= 2 * sizes[s] + 1e-9 for s, t in target.items())
    assert mixing.mix(empty.withColumn("sources", F.array("source"))).count() == 0


def test_min_cost_flow():
    # two patterns; the shared one fills the source that is short, and nothing is repeated without need
    assert mixing.min_cost_flow([10, 10], [[0], [0, 1]], [12, 8]) == [{0: 10}, {0: 2, 1: 8}]
    assert mixing.min_cost_flow([10], [[0]], [15]) == [{0: 15}]


def test_quality(spark, docs, empty):
    def brute(t):
        b = (t or "").encode()
        w = b.split()
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len(w), len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(7, 20)], "doc_id long, quality int, toxic int")
    for r in quality.quality_rules(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        n, rep = brute(r.text)
        assert (r.n_words, r.n_repeat_words, r.base_failed) == (n, rep, n < 50 or 100 * rep > 50 * n)
        assert r.kept is False or not r.base_failed
    assert quality.quality_rules(empty, labels.limit(0)).count() == 0


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((800, 2))
    y = ((x[:, 0] > 0.5) ^ (rng.random(800) < 0.1)).astype(float)
    t = quality.fit_trees(x, y, np.array([1, -1]))
    grid = np.stack([np.linspace(0, 1, 50), np.full(50, 0.5)], 1)
    assert (np.diff(t.margin(grid)) >= -1e-9).all() and (np.diff(t.margin(grid[:, ::-1])) <= 1e-9).all()
    assert ((t.margin(x) > 0) == (y > 0)).mean() > 0.85


def test_language(spark, empty):
    rows = [(i, t, g) for i in range(40) for t, g in [("the thing that with this " * 3, "en"), ("que les eaux des pour dans " * 3, "fr")]]
    d = spark.createDataFrame([(k, t + str(k), g) for k, (_, t, g) in enumerate(rows)] + [(900, None, "en"), (901, "12 !", "fr"), (902, "the that", None)], "doc_id long, text string, lang string")
    p = langid.fit(d)
    got = {r.doc_id: r for r in langid.predict(d, p).collect()}
    assert all(got[k].lang_pred == g for k, (_, _, g) in enumerate(rows)) and got[902].lang_pred == "en"
    assert got[900].lang_pred == got[901].lang_pred == "und" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.fit(empty) == {} and langid.predict(d, {}).where("lang_pred <> 'und'").count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(1500, 24)) * rng.random((1500, 1)) * 3).round(4)
    x[1:30] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (2080, []), (2100, [1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(d, F.col("vec_id") % 20 == 0, 10).collect()}
    want = set()
    for q in range(0, 1500, 20):
        s = x @ x[q]
        want |= {(q, int(j)) for j in sorted((j for j in range(1500) if j != q), key=lambda j: (-s[j], j))[:10]}
    assert {q for q, _ in got} == {q for q, _ in want} and len(got & want) / len(want) >= 0.9
    assert {v for q, v in got if q == 0} == {v for q, v in want if q == 0}
    assert ann.nearest(d.limit(0), F.lit(True)).count() == 0


def test_html(spark):
    page = "<body><nav>menu</nav><div class='ad'>buy</div><article><h1>T &amp; t</h1><p>a <b>b</b>\n c<p>d<div class=comments>no</div></article><script>var t='</p>';</script><footer>f</footer></body>"
    d = spark.createDataFrame([(1, "http://h/1", page), (2, None, None), (3, "x", ""), (4, "http://h/2", "<p>only <i>text</i></p><p>tw")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltree.html_main_text(d).collect()}
    assert got == {1: "T & t\na b c\nd", 2: "", 3: "", 4: "only text\ntw"}
    same = spark.createDataFrame([(i, "http://h/x", f"<div id=top>same on each page</div><div id=own>own text {i}</div>") for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in htmltree.html_main_text(same).collect()} == {f"own text {i}" for i in range(9)}
    assert htmltree.html_main_text(d.limit(0)).count() == 0


def test_licenses(spark):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/x.c", "int x;"), (3, "c/y.c", "Released under the MIT License."), (4, None, None), (5, "d", "")]
    scanned = licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string"))
    dirs = scanned.where("path like '%LICENSE'").select(F.lit("a").alias("directory"), F.col("own_license").alias("license"), F.col("own_score").alias("score"))
    got = {r.file_id: (r.own_license, r.license) for r in licenses.inherit(scanned, dirs).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0"), 2: (None, "Apache-2.0"), 3: ("MIT", "MIT"), 4: (None, None), 5: (None, None)}
