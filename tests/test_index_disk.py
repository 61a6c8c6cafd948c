"""What the kept index puts on disk, and its rows where parts end early, tables aren't handed out, and keys are strings."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspark.operators import search, textindex
from loomspark.sources import manifest, scratch

COMMON = [f"kelime{i}" for i in range(400)]


def texts(spark, n, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice(COMMON) if rng.random() < 0.7 else f"{rng.getrandbits(40):x}"
    return spark.createDataFrame([(i, word(), " ".join(word() for _ in range(150))) for i in range(n)], "key long, title string, content string").repartition(3).cache()


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def shuffled(spark):
    """MB that the session's tasks have written for shuffles so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size())) / 1e6


def as_rows(df):
    return sorted((r.qid, r["rank"], str(r.key), r.score) for r in df.collect())


def asked(spark):
    rng = random.Random(8)
    return spark.createDataFrame([(i, " ".join(rng.choices(COMMON, k=6))) for i in range(20)], "qid long, text string")


def test_an_update_keeps_and_shuffles_no_postings(spark, tmp_path):
    """Postings were written before they were arranged, and moved with their keys and lengths in four shuffles."""
    docs, path = texts(spark, 3000), f"{tmp_path}/ix"
    whole = docs.agg(F.sum(F.length("content"))).first()[0] / 1e6
    before, tables = shuffled(spark), len(scratch.WRITTEN)
    textindex.update(spark, path, docs)
    first = shuffled(spark) - before
    assert first < 0.05 * whole and len(scratch.WRITTEN) == tables
    changed = docs.withColumn("title", F.when(F.col("key") % 10 == 1, "eski").otherwise(F.col("title")))
    textindex.update(spark, path, changed)
    second, kept = shuffled(spark) - before - first, sum(size(p.removeprefix("file://")) for p in scratch.WRITTEN[tables:]) / 1e6
    # keys and hashes, and a count for each term of the changed documents
    assert second < 0.25 * whole and kept < 0.05 * whole and size(path) / 1e6 < 1.2 * whole


@pytest.mark.parametrize("key", ["long", "string"])
@pytest.mark.parametrize("handed", [True, False])
def test_rows_are_those_of_text_search(spark, tmp_path, monkeypatch, key, handed):
    monkeypatch.setattr(textindex, "RANGE", 4)
    monkeypatch.setattr(textindex, "MOST_PAIRS", 3000)  # about 25 documents, of 32 in a part
    if not handed:
        monkeypatch.setattr(textindex, "FEW_ROWS", -1)
        monkeypatch.setattr(textindex, "FEW_CHARS", -1)
    path, questions = f"{tmp_path}/ix", asked(spark)
    docs = texts(spark, 400).withColumn("key", F.col("key").cast(key))
    # repeated updates leave small parts; a null, an empty and a very long text
    odd = spark.createDataFrame([("9001", None, None), ("9002", "", ""), ("9003", "kelime1", " ".join(COMMON) + " kelime2" * 70_000)], "key string, title string, content string")
    docs = docs.unionByName(odd.withColumn("key", F.col("key").cast(key)))
    number = F.col("key").cast("long")
    steps = [docs.where(number % 3 == 0), docs.where(number % 3 != 1), docs.where(number % 7 != 0).withColumn("title", F.when(number % 5 == 1, "kelime3").otherwise(F.col("title")))]
    for now in steps:
        textindex.update(spark, path, now)
        assert as_rows(textindex.search_index(spark, path, questions, 7, 2)) == as_rows(search.search_docs(now, questions, 7))
    content = textindex.Index(spark, path).content
    assert content["gone"] > 0 and textindex.update(spark, path, steps[-1])["same"] == steps[-1].count()
    textindex.compact(spark, path)
    index = textindex.Index(spark, path)
    assert (index.content["docs"], index.content["tokens"]) == (content["docs"], content["tokens"])
    assert index.docs().count() == steps[-1].count() and index.parts().where(F.size("keys") > 32).count() == 0 and index.parts().count() < 24
    assert as_rows(textindex.search_index(spark, path, questions, 7, 2)) == as_rows(search.search_docs(steps[-1], questions, 7))
    assert textindex.update(spark, path, steps[-1]).get("version") is None


def test_a_few_terms_read_their_buckets(spark, tmp_path):
    path = f"{tmp_path}/ix"
    textindex.update(spark, path, texts(spark, 300))
    index = textindex.Index(spark, path)
    one = spark.createDataFrame([(1, "kelime5 kelime6")], "qid long, text string")
    names = textindex._bounds(index, one)[0]
    found = {r.bucket for r in names.collect()}
    near = textindex._within(index, names)
    assert len(found) in (1, 2) and {r.bucket for r in near.select("bucket").distinct().collect()} == found
    assert "bucket" in near._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_an_older_format_is_refused(spark, tmp_path):
    path = f"{tmp_path}/ix"
    manifest.commit(spark, path, 1, {"segments": ["a"], "docs": 1, "tokens": 1, "key_type": "bigint"})
    with pytest.raises(ValueError, match="older format"):
        textindex.Index(spark, path)
