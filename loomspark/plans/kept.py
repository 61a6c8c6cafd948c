"""Queries over tables that are kept on disk: the inverted index, inverted lists, the neighbour graph, keyed streams; and walks by level."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomspark.operators import grepindex, layout, lists, nngraph, search, textindex
from loomspark.operators.policy import Policy, TablePolicy
from loomspark.plans import registry
from loomspark.plans import relations as R
from loomspark.plans.registry import query
from loomspark.sources.scratch import folder
from loomspark.streaming import keyed


def _place(spark) -> str:
    return f"{folder(spark)}/{uuid.uuid4().hex}"


@query(registry.SQL["text_search"])
def text_index_search(spark, d):
    """The questions against a kept index that was first made of three quarters of the documents, then brought up to date."""
    path = _place(spark)
    docs = search.prefilter(R.docs(spark, d)).select("key", "title", "content")
    before = docs.where("key % 4 <> 0").withColumn("title", F.when(F.col("key") % 10 == 1, "eski").otherwise(F.col("title")))
    textindex.update(spark, path, before)
    textindex.update(spark, path, docs)
    return textindex.search_index(spark, path, R.questions(spark, d), 10)


_ASKED = "(SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0)"


@query(f"SELECT count(*) AS vectors, {_ASKED} AS queries, CAST(k AS INTEGER) AS k, true AS reached FROM embeddings, (VALUES (1), (10), (30)) ks(k) GROUP BY k")
def vector_lists_recall(spark, d):
    """Whether kept lists, with probes tuned to it, find nine in ten of the exact nearest; the queries are every hundredth vector, the others all."""
    path, v = _place(spark), R.vectors(spark, d).select("key", "vec")
    lists.build(v, path)
    lists.tune(v, path, 30)
    asked = v.where("key % 100 = 0").select(F.col("key").alias("qid"), "vec")
    rows = None
    for k in (1, 10, 30):
        own = lists.recall(v, asked, path, k).select(F.col("vectors").cast("long").alias("vectors"), "queries", "k", (F.col("recall") >= 0.9).alias("reached"))
        rows = own if rows is None else rows.unionByName(own)
    return rows


@query("SELECT (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS asked, least(15, (SELECT count(*) FROM embeddings) - 1) * (SELECT count(*) FROM embeddings) AS entries, true AS reached")
def neighbor_descent(spark, d):
    """The approximate neighbour graph: its size, and whether lists of every hundredth vector hold nine in ten of the exact neighbours."""
    v = R.vectors(spark, d).select("key", "vec")
    graph = registry.written(nngraph.descend(v))
    asked = v.where("key % 100 = 0").select(F.col("key").alias("qid"), "vec")
    true = search.knn(v, asked, 16).where("key <> qid").select(F.col("qid").alias("key"), F.col("key").alias("neighbor"), "score", "rank")
    place = F.row_number().over(registry.Window.partitionBy("key").orderBy("rank"))
    true = true.withColumn("r", place).where("r <= 15").select("key", "neighbor")
    found = true.join(graph.select("key", "neighbor", F.lit(1).alias("hit")), ["key", "neighbor"], "left").agg((F.sum("hit") / F.count("*") >= 0.9).alias("reached"))
    sizes = v.agg(F.count("*").alias("vectors"), F.count_if(F.col("key") % 100 == 0).alias("asked"))
    return sizes.crossJoin(graph.agg(F.count("*").alias("entries"))).crossJoin(found)  # one row each


@query("SELECT count(*) AS points, true AS in_ball, true AS nearer FROM embeddings")
def spectral_map(spark, d):
    """The map by the neighbour graph: all points lie in the unit ball, and neighbours lie nearer to each other than points do on the whole."""
    v = R.vectors(spark, d).select("key", "vec")
    graph = registry.written(nngraph.descend(v))
    points = registry.written(layout.spectral3d(graph))
    other = points.select(F.col("key").alias("neighbor"), *(F.col(a).alias(f"n{a}") for a in "xyz"))
    apart = graph.join(points, "key").join(other, "neighbor").agg(F.avg(sum(F.pow(F.col(a) - F.col(f"n{a}"), 2) for a in "xyz")).alias("near"))
    # the mean squared distance of all pairs, by the variances
    whole = points.agg(F.count("*").alias("points"), (F.max(F.expr("x * x + y * y + z * z")) <= 1.001).alias("in_ball"), (2 * sum(F.var_pop(a) for a in "xyz")).alias("spread"))
    return whole.crossJoin(apart).select("points", "in_ball", (F.col("near") < F.col("spread")).alias("nearer"))  # one row each


_USAGE = R.sql("SELECT day, user_id, tool, calls, errors FROM daily", "daily")


def _events(spark, d):
    raw = spark.readStream.schema(R.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "user_id", F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "failed").alias("error"))


@query(_USAGE)
def keyed_rollup(spark, d):
    """The log as a file stream, added to one table whose buckets a batch touches."""
    at = _place(spark)
    keyed.rollup_stream(_events(spark, d), f"{at}/rollup", f"{at}/state").awaitTermination()
    return keyed.read_rollup(spark, f"{at}/rollup")


@query(R.sql("SELECT user_id, date_trunc('minute', max(\"at\")) AS last_used FROM usage_events WHERE user_id IS NOT NULL GROUP BY user_id", "usage_events"))
def keyed_last_used(spark, d):
    """The log as a file stream; users with a later minute are written."""
    at = _place(spark)
    keyed.last_used_stream(_events(spark, d), f"{at}/last", f"{at}/state").awaitTermination()
    return keyed.read_last_used(spark, f"{at}/last")


@query("SELECT event_type AS tool, count(*) AS calls FROM events WHERE ts IS NOT NULL GROUP BY event_type")
def windows_and_late(spark, d):
    """Closed and open windows and late events of the stream, added up by tool: together all events."""
    at = _place(spark)
    keyed.windows_stream(_events(spark, d), f"{at}/windows", f"{at}/state").awaitTermination()
    parts = [keyed.read_windows(spark, f"{at}/windows", n).select("tool", "calls") for n in ("closed", "open", "late")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("tool").agg(F.sum("calls").alias("calls"))


_TREE = Policy({"files": TablePolicy("files", "a tree", None, True)}, denied="token", key="id")


@query(
    """
WITH RECURSIVE files AS (SELECT DISTINCT doc_id AS id, doc_id // 10 AS parent FROM documents),
walk(start, id, parent, depth) AS (
  SELECT s.parent, f.id, f.parent, 0 FROM (SELECT DISTINCT parent FROM files) s JOIN files f ON f.id = s.parent
  UNION SELECT w.start, f.id, f.parent, w.depth + 1 FROM walk w JOIN files f ON f.id = w.parent WHERE w.depth < 2 AND f.id <> w.id)
SELECT f.id, w.id AS ancestor, CAST(min(w.depth) AS INTEGER) AS depth FROM files f JOIN walk w ON w.start = f.parent GROUP BY ALL
"""
)
def graph_lookup(spark, d):
    """Documents as a tree by their numbers' digits: each one's ancestors up to three levels, with the level."""
    files = R.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("parent")).distinct()
    found = _TREE.graph_lookup(files, files, "files", "parent", "parent", "id", "id", max_depth=2)
    return found.select("id", F.col("found.id").alias("ancestor"), "depth")


@query(registry.SQL["grep_lines"])
def grep_index_lines(spark, d):
    """All lines with a word part, by the trigram index of all documents' lines."""
    at = _place(spark)
    grepindex.build(R.docs(spark, d), at)
    return grepindex.grep(spark, at, "TION", limit=None)
