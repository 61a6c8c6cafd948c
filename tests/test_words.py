"""Words cut and counted by Arrow batches, against the same by column functions."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import index, search, words

TEXTS = ["", None, "Kule  “köprü”,kule?", "’a bb’", "İKİ ıslak ÇAĞ `x` ve\x0bki b c €“x y”é", "日本語 d日", "…sol„sag", " \n", "a", "son kule"] + [f"w{i % 5} (w{i % 3})\tE{i}" for i in range(40)]
ROWS = [(i, f"T{i % 4} kule" if i % 3 else None, t) for i, t in enumerate(TEXTS)] + [(2, "kule", "yine köprü"), (None, "x1", "kule kule")]


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def frame(spark):
    return spark.createDataFrame(ROWS, "key long, title string, content string").repartition(3)


def by_columns(docs):
    """(term, key), a title's terms three times, by column functions alone."""
    own = docs.select("key", *(F.coalesce(T.all_terms(F.col(f)), F.array().cast("array<string>")).alias(f) for f in ("title", "content")))
    return own.select("key", F.explode(F.concat("title", "title", "title", "content")).alias("term"))


def test_cut_takes_words_in_their_rows():
    whole = pa.array(["xx yy", *TEXTS])
    for texts, size in ((whole.slice(1), len(TEXTS)), (pa.array(TEXTS), len(TEXTS)), (pa.array([], pa.string()), 0), (pa.array(["", None], pa.string()), 2)):
        rows, got = words.cut(texts, T.BREAKS)
        plain = [(i, w) for i, t in enumerate(texts.to_pylist()) for w in (t or "").translate({ord(c): " " for c in T.BREAKS}).split(" ") if w]
        assert list(zip(rows.tolist(), got.to_pylist(), strict=True)) == plain and len(texts) == size


def test_counts_are_those_of_column_functions(spark, monkeypatch):
    monkeypatch.setattr(words, "SLICE", 16)
    docs = frame(spark)
    want = by_columns(docs).groupBy("term", "key").agg(F.count("*").alias("tf"))
    assert rows_of(search.postings(docs), "term", "key", "tf") == rows_of(want, "term", "key", "tf")


def test_vectors_are_those_of_column_functions(spark):
    docs = frame(spark)
    bucket = F.pmod(F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long"), F.lit(64)).cast("int")
    want = {}
    for r in docs.select("key", F.explode(T.all_terms(F.col("content"))).alias("term")).groupBy("key", bucket.alias("b")).count().collect():
        want.setdefault(r.key, Counter())[r.b] = float(r["count"])
    got = {r.key: r.vec for r in index.term_vectors(docs, "key", "content").collect()}
    assert got == {k: [c[b] for b in range(64)] for k, c in want.items()}


def test_a_scan_leaves_counts_and_not_words(spark):
    """Each word of a text became a row of its own before it was counted."""
    docs = frame(spark)
    for df in (search.postings(docs), index.term_vectors(docs, "key", "content")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "MapInArrow" in plan


def test_texts_stay_where_they_are(spark, tmp_path, monkeypatch):
    """Whole texts were shuffled to meet their labels when these were over the session's threshold."""
    from loomspark.plans import relations as R

    spark.range(5).selectExpr("id AS doc_id", "'a\nb' AS text", "'en' AS lang", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(3).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        few = R.docs(spark, str(tmp_path))
        monkeypatch.setattr(R, "FEW_LABELS", 2)
        many = R.docs(spark, str(tmp_path))
        assert "Exchange hashpartitioning" not in few._jdf.queryExecution().executedPlan().toString()
        assert rows_of(few, "key", "status") == rows_of(many, "key", "status") == [(i, "kaldırıldı" if i == 1 else "canlıda") for i in range(5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
