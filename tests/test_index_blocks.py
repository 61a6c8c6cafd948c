"""The kept index scores blocks of ranges for many questions at a time."""

from pyspark.sql import functions as F

from loomspark.operators import textindex


def test_k_of_a_block_leave_it(spark, tmp_path, monkeypatch):
    """A row for each question, term and document was what a search shuffled and added up."""
    monkeypatch.setattr(textindex, "RANGE", 10)
    path = f"{tmp_path}/ix"
    docs = spark.range(60).select(F.col("id").alias("key"), F.lit("ortak").alias("title"), F.concat(F.lit("kelime"), F.col("id") % 3).alias("content"))
    textindex.update(spark, path, docs)
    questions = spark.createDataFrame([(q, "ortak kelime1") for q in range(4)], "qid long, text string")
    index = textindex.Index(spark, path)
    asked, bounds = textindex._bounds(index, questions)
    found = textindex._scored(index, asked, bounds.select("qid", "range"), 3).collect()
    # one block: sixty documents, of which three stay for each question, by score and key
    assert {(r.qid, r.key) for r in found} == {(q, k) for q in range(4) for k in (1, 4, 7)} and len(found) == 12
