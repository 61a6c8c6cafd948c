"""Near copies against brute force, and the pipeline's run over planted ones."""

import random

import corpus_pipeline
import numpy as np
from loomspark.llm import nearcopies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    texts = [None, "", "one two", "ONE  two", "one two three"]
    for length in (60, 120, 400):
        for edits in (1, 2, 4, 9):
            base = [word() for _ in range(length)]
            texts.append(" ".join(base))
            for _ in range(3):
                near = list(base)
                for _ in range(edits):
                    near[rng.randrange(length)] = word()
                texts.append(" ".join(near))
    base = [word() for _ in range(300)]  # a large group, and links that hold only by way of others
    for k in range(60):
        near = list(base)
        near[5 * k % 300] = word()
        texts.append(" ".join(near))
    for k in range(0, 120, 8):
        texts.append(" ".join(base[k:] + base[:k]) if k % 16 else " ".join(base[k : k + 180]))
    return [(i, t, "en", "ab"[i % 2], len(t or "")) for i, t in enumerate(texts)] + [(9, "another text of the same id", "en", "a", 27), (None, texts[5], "en", "a", 1)]


def brute(rows):
    """The smallest id of each document's component, by all pairs."""
    known = [(r[0], r[1]) for r in rows if r[0] is not None]
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    sets = [(i, grams(t)) for i, t in known]
    for i, a in sets:
        for j, b in sets:
            if i < j and len(a & b) / len(a | b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in known}


def test_components_of_near_copies(spark):
    rows = planted()
    want = brute(rows)
    got = nearcopies.near_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert nearcopies.near_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_and_alike():
    a = nearcopies.shingles(" ".join(map(str, range(9000))))
    assert len(a) == 8996 and (nearcopies.band_keys(a) == nearcopies.band_keys(a.copy())).all()
    x = lambda *v: np.array(v, np.uint64)
    assert nearcopies.alike(x(1, 2, 3, 4, 5), x(1, 2, 3, 4), 0.8) and not nearcopies.alike(x(1, 2, 3, 4, 5), x(1, 2, 3, 6), 0.8)


def test_pipeline_keeps_one_of_each_group(spark, tmp_path):
    rows = [r for r in planted() if r[1] and len(r[1].split()) >= 50 and r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:20]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = brute(rows)
    firsts = {i for i, c in want.items() if i == c}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, corpus_pipeline.table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()}
    assert kept == firsts and len(firsts) < len(rows)
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out and len({want[i] for i in out}) == len(out)
