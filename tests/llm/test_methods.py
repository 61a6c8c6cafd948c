"""Each method against plain Python: edges, ties, repeats, clashing columns, long texts, and what the method itself decides."""

import hashlib
import random
import time
from html.parser import HTMLParser

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loomspark.llm import ann, bpe, htmltree, langid, licenses, linededup, mixing, nearcopies, quality, simhash, suffixes
from test_nearcopies import SCHEMA, brute, planted


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


# --- line dedup


def test_line_dedup_streams_sorted_occurrences(spark):
    line = "this line is longer than forty code points, surely"
    rows = [(i, f"{line}\n{i} own\n{line.upper()}  ", "x", "y") for i in range(9)] + [(3, f"{line}\n3 own\n{line.upper()}  ", "x", "y"), (None, line, "x", "y"), (20, None, "x", "y"), (21, "", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, salt string, keep string")
    plan = linededup.sorted_stream(linededup.occurrences(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Sort" in plan and "rangepartitioning" in plan and "Python" not in plan
    got = linededup.line_dedup(docs).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got if r.doc_id is not None and r.doc_id < 9} == {(i, 3, 2, f"{i} own") for i in range(8)} | {(8, 3, 0, rows[8][1])}
    assert [(r.n_dropped, r.kept) for r in got if r.doc_id is None] == [(0, line)] and {r.kept for r in got if r.doc_id in (20, 21)} == {""}


def test_keep_bitmaps_hold_only_words_that_drop(spark):
    line = "another line that is longer than forty code points"
    text = "\n".join([f"{k}" for k in range(200)] + [line])
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    for r in linededup.keep_bitmaps(docs).collect():
        assert r.n_dropped == 1 and [(w.word, w.bits) for w in r["keep"]] == [(3, ~(1 << 8))]


# --- near copies


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PART", 8)
    monkeypatch.setattr(nearcopies, "HOT", 1)
    rows = planted() + [(1000 + i, planted()[8][1], "en", "a", 1) for i in range(12)]
    got = {r.doc_id: r.component_id for r in nearcopies.near_components(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id is not None}
    assert got == brute(rows)


def test_hot_fingerprints_are_salted(spark, monkeypatch):
    docs = spark.createDataFrame([*planted(), *((2000 + i, planted()[6][1], "en", "a", 1) for i in range(40))], SCHEMA)
    told = lambda: sorted((r.doc_id is None, r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(docs).collect())
    plain = told()
    monkeypatch.setattr(simhash, "HOT", 1)
    assert told() == plain and len({c for _, i, _, c in plain if i is not None and i >= 2000}) == 1


# --- html


class Plain(HTMLParser):
    """Text of the blocks of well-formed pages, without elements that are noise by tag."""

    def __init__(self):
        super().__init__()
        self.skip, self.blocks, self.open = 0, [], []

    def close_block(self):
        text = " ".join("".join(self.open).split())
        self.open = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in htmltree.BLOCK:
            self.close_block()
        self.skip += tag in htmltree.NOISE_TAGS

    def handle_endtag(self, tag):
        if tag in htmltree.BLOCK:
            self.close_block()
        self.skip -= tag in htmltree.NOISE_TAGS

    def handle_data(self, data):
        if not self.skip:
            self.open.append(data)


def test_html_against_another_parser():
    rng = random.Random(2)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return words(rng, rng.randint(1, 4), "ab&<é ").replace("&", "&amp;").replace("<", "&lt;")
        tag = rng.choice("div section ul b i span nav table footer".split())
        return f"<{tag} title='x>y' data-k=\"a'b\">{''.join(tree(depth - 1) for _ in range(rng.randint(1, 3)))}</{tag}>"

    for _ in range(300):
        page = f"<body>{tree(5)}</body>"
        p = Plain()
        p.feed(page)
        p.close_block()
        assert htmltree.main_text(page, frozenset()) == "\n".join(p.blocks), page


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p class=a'>keep this</p><p>and don't lose</p></article>", "keep this\nand don't lose"),
        ("<article><h1>T</h1><div class=ad-slot>x</div><div class=cookie-banner>x</div><div class=siteNav>x</div><p>y</p><div id=user-comments>x</div></article>", "T\ny"),
        ("<div class='content-with-sidebar'><h1>T</h1><p>whole</p></div>", "T\nwhole"),
        ("<main><h1>T</h1><p>text</p><article class=comment>first!</article></main>", "T\ntext"),
        ("<div><p>the main text of this page stands in a plain element</p></div><article>card</article>", "the main text of this page stands in a plain element\ncard"),
        ("<p>one<p>two<ul><li>a<li>b</ul><a x=\"", "one\ntwo\na\nb"),
        ("<p>a &amp; b &#233;</p><!-- <p>no</p> --><p>c", "a & b é\nc"),
    ],
)
def test_html_pages(page, text):
    assert htmltree.main_text(page, frozenset()) == text


def test_style_tree_decides_inside_articles(spark):
    rng = random.Random(1)
    page = lambda i: f"<article><h1>title {i}</h1><p>{words(rng, 30)}</p><div class=follow>Follow us for more like this</div></article>"
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(8)] + [(100 + i, f"https://small.example/{i}", page(100 + i)) for i in range(2)]
    rows += [(200, "https://h.example/0", rows[0][2]), (201, "https://h.example/0", rows[0][2])]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    tree = htmltree.style_tree(d)
    on = {r.page_id: r.text for r in htmltree.extract(d, tree).collect()}
    off = {r.page_id: r.text for r in htmltree.extract(d, tree.limit(0)).collect()}
    assert all("Follow us" in t for t in off.values())
    assert {i for i, t in on.items() if "Follow us" in t} == {100, 101} and all("title" in t for t in on.values()) and on[200] == on[0] == on[201]


def test_html_takes_time_by_length():
    def took(page):
        began = time.process_time()
        htmltree.main_text(page, frozenset())
        htmltree.nodes(page)
        return time.process_time() - began

    for piece in ("<div>", '<a "', '<a x="', "<p><button><div>", "</b>", "<!--", "<li>x"):
        assert took(piece * 20_000) < 100 * max(took(piece * 1_000), 0.01), piece  # a square would be 400


# --- licences

APACHE = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
GPL = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
BSD = " * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Redistributions of source code must retain the above copyright notice, this\n *    list of conditions and the following disclaimer.\n * 2. Redistributions in binary form must reproduce the above copyright notice,\n *    this list of conditions and the following disclaimer in the documentation\n *    and/or other materials provided with the distribution.\n * 3. Neither the name of the copyright holder nor the names of its\n *    contributors may be used to endorse or promote products derived from\n *    this software without specific prior written permission."
FILES = [
    ("LICENSE", APACHE, "Apache-2.0", "Apache-2.0"),
    ("src/a.c", "int a;", None, "Apache-2.0"),
    ("src/b.c", "// SPDX-License-Identifier: MIT\nint b;", "MIT", "MIT"),
    ("third/bsd/COPYING", BSD, "BSD-3-Clause", "BSD-3-Clause"),
    ("third/bsd/deep/er/x.c", "int x;", None, "BSD-3-Clause"),
    ("third/y.c", GPL, "GPL-3.0-or-later", "GPL-3.0-or-later"),
    ("third/z.c", "a long line that goes on and on before it says Released under the ISC License. and after", "ISC", "ISC"),
    ("src/c.c", "/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License. */", "Apache-2.0", "Apache-2.0"),
    ("src/d.c", "SPDX-License-Identifier: Apache-2.0", "Apache-2.0", "Apache-2.0"),
    ("src/e.c", "MIT License", "MIT", "MIT"),
    ("src/f.c", "we permit licensed users to emit licenses", None, "Apache-2.0"),
    (None, None, None, None),
]


def test_licence_files_headers_and_inheritance(spark):
    rows = [(i, p, t, "clash", 1) for i, (p, t, _, _) in enumerate(FILES)] + [(2, *FILES[2][:2], "clash", 1)]
    scanned = licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string, line string, size int"))
    assert scanned.count() == len(rows)
    files = scanned.where(F.col("path").rlike("(^|/)(LICENSE|COPYING)$"))
    # a second, weaker file in a directory gives way; of equal ones the first by name counts
    dirs = files.select(F.regexp_replace("path", "/?[^/]*$", "").alias("directory"), F.col("own_license").alias("license"), F.col("own_score").alias("score"))
    dirs = dirs.unionByName(spark.createDataFrame([("third/bsd", "ZZZ", 1.0), ("", "AAA", 0.7)], dirs.schema))
    got = {(r.file_id, r.own_license, r.license) for r in licenses.inherit(scanned, dirs).collect()}
    assert got == {(i, own, all_) for i, (_, _, own, all_) in enumerate(FILES)}
    assert licenses.scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


def test_every_template_is_found(spark):
    made = licenses.templates()
    rows = [(i, None, f"x\n{t}.\ny") for i, (_, t) in enumerate(made)]
    got = {r.file_id: r.own_license for r in licenses.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).collect()}
    assert all(got[i] == k for i, (k, t) in enumerate(made) if len(t.split()) > 2)


# --- nearest vectors


def test_nearest_over_several_files(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16)).round(3)
    short = rng.normal(size=(70, 5)).round(3)
    rows = [(i, [float(v) for v in a], "c", 1) for i, a in enumerate(x)] + [(10_000 + i, [float(v) for v in a], "c", 1) for i, a in enumerate(short)] + [(20_000, [1.0, 2.0], "c", 1), (20_001, [2.0, 1.0], "c", 1), (5, [float(v) for v in x[5]], "c", 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, list string, class int")
    out = ann.nearest(d, F.col("vec_id") % 20 == 0, 10).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for ids, m in ((np.arange(3000), x), (np.arange(10_000, 10_070), short), (np.array([20_000, 20_001]), np.array([[1.0, 2.0], [2.0, 1.0]]))):
        m = m.astype(np.float32).astype(np.float64)
        for q in np.flatnonzero(ids % 20 == 0):
            s = m @ m[q]
            want = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != q][:10]
            mine = got[int(ids[q])]
            assert len(mine) == min(10, len(ids) - 1) and [v for v, _ in mine] == [v for v, _ in sorted(mine, key=lambda t: (-t[1], t[0]))]
            assert all(abs(v - s[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, v in mine)
            hit, total = hit + len({i for i, _ in mine} & set(want)), total + len(want)
    assert hit / total >= 0.9


# --- language


def test_trigrams_do_not_depend_on_the_cut(monkeypatch):
    text = words(random.Random(1), 4000, "abé1 -日")
    whole = langid.trigrams(text)
    for piece in (1, 2, 3, 7, 1000):
        monkeypatch.setattr(langid, "PIECE", piece)
        codes, counts = langid.trigrams(text)
        assert (codes == whole[0]).all() and (counts == whole[1]).all()


def test_language_of_held_out_documents(spark):
    rng = random.Random(5)
    alphabets = {"aa": "abcdeimn", "bb": "bcdfoqrs", "cc": "tuvwxyza"}
    rows = [(i, words(rng, 60, alphabets[lang]), lang if i % 5 else None, lang, "c") for i, lang in enumerate(list(alphabets) * 60)]
    rows += [(1000, words(rng, 60_000, alphabets["bb"]), None, "bb", "c"), (1, *rows[1][1:])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, score string")
    got = langid.predict(d, langid.fit(d, F.col("doc_id") % 4 != 2), ["doc_id", "truth"]).where("doc_id % 4 = 2 or doc_id = 1000").collect()
    assert len(got) > 40 and all(r.lang_pred == r.truth and 0 < r.score <= 1 for r in got)
    # two languages of the same documents: the tie goes to the first by code point
    same = spark.createDataFrame([(1, "same text", "zz"), (2, "same text", "aa")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.predict(same, langid.fit(same)).collect()} == {"aa"}


# --- mixing


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    rng = random.Random(6)
    rows = [(i, words(rng, rng.randint(20, 60)), rng.choice("abc"), "c", 7) for i in range(1500)] + [(9000, None, "a", "c", 7), (9001, "", None, "c", 7)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, pattern string, h int").withColumn("sources", F.array("source"))
    one, two = ({(r.doc_id, r.taken) for r in mixing.mix(d.repartition(k)).collect()} for k in (2, 5))
    assert one == two
    taken, target = {}, {}
    for r in mixing.mix(d).collect():
        taken[r.sources[0]], target[r.sources[0]] = taken.get(r.sources[0], 0) + r.taken, r.target
        assert r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 120 for s in target)


def test_mixing_of_overlapping_sources(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, 20), s) for i, s in enumerate([["a"]] * 100 + [["a", "b"]] * 100 + [["b"]] * 10)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"), weights=(1, 1, 1)).collect()
    total, target = sum(r.taken for r in out), {r.sources[0]: r.target for r in out}
    assert abs(total - sum(target.values())) <= 120 and all(r.taken in (0, 20, 40) for r in out)
    # what only one source has is used before what both have is repeated more than it must
    assert sum(r.taken for r in out if r.sources == ["b"]) >= 200


# --- quality


def test_all_counts_against_plain_python(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "a b c a b c", "x #*$ y & |<> %", "l1\nl1\n \nl1\nl2"] + ["\n".join(words(rng, rng.randint(0, 12), "abcé#<") for _ in range(rng.randint(1, 30))) for _ in range(40)] + [words(rng, 30_000)]
    rows = [(i, t, 1, "c") for i, t in enumerate(texts)] + [(3, texts[3], 1, "c")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6, 40)] + [(7, 0, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string"), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        w = t.encode().split()
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        repeated = len({i + k for v in seen.values() if len(v) > 1 for i in v for k in range(3)})
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeated)
        assert r.base_failed == (len(w) < 50 or 100 * repeated > 50 * len(w)) and (not r.kept or not r.base_failed)
    # no labels, or one class: the base rule alone decides
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.kept != r.base_failed for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string"), few).collect())


# --- byte-level BPE


def test_long_words_and_small_memories():
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["a" * 3000, "ab" * 1500, "".join(rng.choice("abcdeioutn") for _ in range(5000)), "中文" * 900, "-=" * 2000] + ["".join(rng.choice(["the", "ing", "er", "tion", "qu", "z", "é"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for states, kept in ((600_000, 300_000), (50, 3)):
        c = bpe.Codec(ranks, public_tokenizers.PATTERN, states, kept)
        for t in texts:
            ids, _ = c.encode(t)
            assert ids == enc.encode_ordinary(t) and c.trip(t)[1] == t


# --- suffixes


def test_windows_read_off_the_merged_order():
    rng, width = random.Random(1), 20

    def hashed(group):
        best, seen = {}, []
        for suffix, before, doc, start in group:
            t = before + suffix
            for j in range(len(t) - width + 1):
                k, here = t[j : j + width], (doc, start + j)
                seen.append((k, here))
                best[k] = min(best.get(k, here), here)
        return {(d, x) for k, (d, a) in seen if best[k] != (d, a) for x in range(a, a + width)}

    for _ in range(1500):
        group = []
        for _ in range(rng.choice([2, 3, 5, 9, 13, 30])):
            before = bytes(rng.choice(b"ab") if rng.random() < 0.3 else 97 for _ in range(rng.randint(0, width - 8)))
            rest = rng.randint(1, len(before) + 1) + width - 1 - len(before) - 8
            if rest >= 0:
                group.append((b"GGGGGGGG" + bytes(rng.choice(b"xy") if rng.random() < 0.1 else 120 for _ in range(rest)), before, rng.randint(0, 4), rng.randint(0, 500)))
        group.sort()
        if len(group) > 1:
            shared = [0, *(suffixes.common(a[0], b[0], 0) for a, b in zip(group, group[1:]))]
            assert {(d, x) for d, a, z in suffixes.repeated(group, shared, width) for x in range(a, z)} == hashed(group)


# --- the pipeline's stages


def test_stages_on_edges(spark, tmp_path):
    p = corpus_pipeline
    rng = random.Random(3)
    good = [words(rng, 80) for _ in range(30)]
    line = "a line that stands in many of these documents, word by word"
    rows = [(i, f"{t}\n{line}", "en", "ab"[i % 2], 1) for i, t in enumerate(good)] + [(None, good[0], "en", "a", 1), (50, None, None, None, None), (51, "", "en", None, 0), (3, f"{good[3]}\n{line}", "en", "b", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = p.table(spark, str(tmp_path), "documents")
    clash = docs.withColumn("kept", F.lit("c")).withColumn("n_lines", F.lit(1))
    empty = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    kept = p.quality_rules(spark, clash, str(tmp_path))
    assert kept.columns == list(p.COLUMNS) and {r.doc_id for r in kept.collect()}.isdisjoint({50, 51})
    lines = p.line_dedup(spark, clash, str(tmp_path))
    texts = {(r.doc_id, r.text) for r in lines.collect()}
    assert lines.columns == list(p.COLUMNS) and lines.count() == len(rows) and (50, None) in texts and (29, f"{good[29]}\n{line}") in texts and (4, good[4]) in texts
    near = p.near_dedup(spark, clash, str(tmp_path)).collect()
    # texts without words are copies of one another; a row without an id stays; a repeated row goes
    assert sorted((r.doc_id is None, r.doc_id) for r in near if r.doc_id is not None) == [(False, i) for i in [*range(30), 50]] and sum(r.doc_id is None for r in near) == 1
    mixed = p.mix_sources(spark, clash, str(tmp_path)).collect()
    times = {}
    for r in mixed:
        times[r.doc_id, r.text] = times.get((r.doc_id, r.text), 0) + 1
    assert set(times.values()) <= {1, 2, 4} and all(t for _, t in times)
    out = {r.doc_id: r for r in p.byte_bpe(spark, docs.where("doc_id is not null"), str(tmp_path)).collect()}
    assert out[50].n_tokens == 0 and out[4].decoded_sha256 == hashlib.sha256(rows[4][1].encode()).hexdigest()
