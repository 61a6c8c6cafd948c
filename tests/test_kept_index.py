"""The kept index, bucketed tables and their manifests."""

import random

import pytest
from pyspark.sql import functions as F

from loomspark.operators import buckets, index, search, textindex
from loomspark.sources import manifest

WORDS = [f"kelime{i}" for i in range(120)]


def made_docs(seed, n):
    rng = random.Random(seed)
    common = ["ortak", "genel"]
    text = lambda: " ".join(rng.choices(common, k=rng.randrange(3)) + rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=rng.randrange(0, 40)))
    return {i: (rng.choice(WORDS), text()) for i in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(k, t, c) for k, (t, c) in docs.items()], "key long, title string, content string")


def asked(spark, n=25, seed=3):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, " ".join(rng.choices([*WORDS, "ortak", "yokboyle"], k=rng.randrange(1, 6)))) for i in range(n)], "qid long, text string")


def as_rows(df):
    return sorted((r.qid, r["rank"], r.key, r.score) for r in df.collect())


def test_kept_index_gives_the_rows_of_text_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "RANGE", 8)
    monkeypatch.setattr(textindex, "BUCKETS", 4)
    path, questions = f"{tmp_path}/ix", asked(spark)
    docs = made_docs(1, 300)
    same = lambda k: as_rows(textindex.search_index(spark, path, questions, k, 2)) == as_rows(search.text_search(search.postings(frame(spark, docs)), questions, k))
    assert textindex.search_index(spark, path, questions).collect() == []
    first = textindex.update(spark, path, frame(spark, docs))
    assert (first["added"], first["version"]) == (300, 1) and same(5) and same(1000)
    # changed, vanished and new documents, in two more segments; counts stay exact
    for turn in range(2):
        other = made_docs(10 + turn, 400)
        for k in range(turn, 60, 7):
            docs[k] = other[k]
        for k in range(100 + turn, 200, 9):
            docs.pop(k, None)
        docs[1000 + turn] = other[5]
        told = textindex.update(spark, path, frame(spark, docs))
        assert told["changed"] and told["removed"] and told["added"] == 1 and told["segments"] == 2 + turn
        assert same(5)
    assert textindex.update(spark, path, frame(spark, docs)).get("version") is None
    assert textindex.compact(spark, path) == 4
    assert textindex.Index(spark, path).content["dead"] == [] and same(5)
    read, of = textindex.ranges_read(spark, path, questions, 3, 2)
    assert read < of
    # an older version still answers as it did
    assert textindex.search_index(spark, path, questions, 5, version=1).count() > 0


def test_one_of_two_index_writers_is_refused(spark, tmp_path):
    path = f"{tmp_path}/ix"
    textindex.update(spark, path, frame(spark, made_docs(1, 20)))
    textindex.update(spark, path, frame(spark, made_docs(2, 20)), expect=1)
    with pytest.raises(manifest.LostRace):
        textindex.update(spark, path, frame(spark, made_docs(3, 20)), expect=1)
    assert textindex.Index(spark, path).version == 2


def test_empty_index(spark, tmp_path):
    path = f"{tmp_path}/ix"
    textindex.update(spark, path, frame(spark, {1: ("", ""), 2: ("bir", None)}).limit(0))
    assert textindex.search_index(spark, path, asked(spark)).collect() == []


def test_a_change_rewrites_only_its_bucket(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(1000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v"))
    assert buckets.change(spark, path, {"t": buckets.Change("k", rows)}, {"c": 1}) == 1
    one = manifest.read(spark, path)[1]["tables"]["t"]["buckets"]
    new = spark.createDataFrame([("7", -1)], "k string, v long")
    assert buckets.change(spark, path, {"t": buckets.Change("k", new)}, {"c": 2}) == 2
    two = manifest.read(spark, path)[1]["tables"]["t"]["buckets"]
    assert len(one) == len(two) == buckets.BUCKETS and sum(one[b] != two[b] for b in one) == 1
    assert buckets.table(spark, path, "t").where("k = '7'").first().v == -1 and buckets.table(spark, path, "t").count() == 1000
    assert buckets.table(spark, path, "t", 1).where("k = '7'").first().v == 14
    # deletes, null keys, an emptied bucket, and a refused writer
    gone = spark.createDataFrame([("7",), ("8",)], "k string")
    buckets.change(spark, path, {"t": buckets.Change("k", spark.createDataFrame([(None, 5), (None, 6)], "k string, v long"), gone)})
    assert buckets.table(spark, path, "t").count() == 1000 and buckets.table(spark, path, "t").where("k is null").count() == 2
    with pytest.raises(manifest.LostRace):
        buckets.change(spark, path, {"t": buckets.Change("k", new)}, version=2)
    buckets.change(spark, path, {"t": buckets.Change("k", spark.createDataFrame([(None, 7)], "k string, v long"))})
    assert [r.v for r in buckets.table(spark, path, "t").where("k is null").collect()] == [7]
    assert buckets.vacuum(spark, path, 1) > 0 and manifest.versions(spark, path) == [4] and buckets.table(spark, path, "t").count() == 999


def test_sync_touches_what_changed(spark, tmp_path):
    path = f"{tmp_path}/s"
    rows = [(f"d{i}", f"h{i}", f"text {i}") for i in range(300)]
    schema = "id string, hash string, embed_text string"

    def embed(texts):
        return index.hash_embedder(4)(texts)

    assert index.sync(spark.createDataFrame(rows, schema), path, embed, "c1")["added"] == 300
    before = manifest.read(spark, path)[1]["tables"]
    rows[5] = ("d5", "new", "other text")
    told = index.sync(spark.createDataFrame(rows, schema), path, embed, "c2")
    after = manifest.read(spark, path)[1]["tables"]
    assert (told["changed"], told["same"]) == (1, 299)
    moved = {n: sum(before[n]["buckets"].get(b) != at for b, at in after[n]["buckets"].items()) for n in after}
    # the ledger's row; the new vector, and the one that no hash asks for any more
    assert moved["ledger"] == 1 and moved["store"] <= 2
    assert buckets.table(spark, path, "store").count() == 300 and buckets.note(spark, path)["commit"] == "c2"
    with pytest.raises(manifest.LostRace):
        index.sync(spark.createDataFrame(rows, schema), path, embed, "c3", expect=1)
