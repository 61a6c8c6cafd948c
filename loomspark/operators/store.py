"""Stored documents and rows of the index: what readers and searches see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunks, index

#: Fixed value: the status of documents that have none, so that it can be asked for.
NO_STATUS = "yok"


def doc_rows(docs: DataFrame) -> DataFrame:
    """(path, title, kind, module, status, text, hash) of documents (path, meta, text) as they are stored.

    Unlike a chunk's, the kind is the head's type or empty, never the folder; missing fields are empty.
    """
    rows = chunks.doc_columns(docs.select("path", "meta", "text"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    kind = F.when(F.col("path").startswith("usecases/"), "usecase").otherwise(empty(F.get_json_object("meta", "$.type")))
    title = F.coalesce(F.nullif("title", F.lit("")), T.basename(F.col("path"), ".md"))
    return rows.select("path", title.alias("title"), kind.alias("kind"), empty(F.col("module")).alias("module"), empty(F.col("status")).alias("status"), "text", T.sha(F.col("text")).alias("hash"))


def sync_docs(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, state): written (new, or its hash changed), removed, or same; both sides have (path, hash)."""
    state = index.diff(docs, stored, "path")
    return state.select("path", F.when(F.col("state").isin("added", "changed"), "written").otherwise(F.col("state")).alias("state"))


def apply_docs(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """The stored documents after ``sync_docs``: written rows replace the old ones, gone documents leave."""
    states = sync_docs(docs.select("path", "hash"), stored.select("path", "hash"))
    kept = stored.join(states.where("state = 'same'"), "path", "left_semi")
    return kept.unionByName(docs.join(states.where("state = 'written'"), "path", "left_semi"))


def index_row(rows: DataFrame) -> DataFrame:
    """``rows`` of chunks as the index holds them: list fields as text, headings as a path, and a status for those without one."""
    listed = [c for c in ("aliases", "sources") if c in rows.columns and rows.schema[c].dataType.typeName() == "array"]
    out = rows.withColumns({c: F.coalesce(F.array_join(c, ", "), F.lit("")) for c in listed})
    if rows.schema["headings"].dataType.typeName() == "array":
        out = out.withColumn("headings", F.coalesce(F.array_join("headings", chunks.GAP), F.lit("")))
    return out.withColumn("status", F.coalesce(F.nullif("status", F.lit("")), F.lit(NO_STATUS)))


def hit_row(hits: DataFrame) -> DataFrame:
    """Hits as they are shown: the filler status is empty again, the score has four places."""
    return hits.withColumns({"status": F.when(F.col("status") == NO_STATUS, "").otherwise(F.coalesce("status", F.lit(""))), "score": F.round("score", 4)})


def list_docs(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Documents below a prefix (a leading ./ or / counts for nothing), without their texts, by path."""
    start = prefix[2:] if prefix.startswith("./") else prefix.removeprefix("/")
    return docs.where(F.col("path").startswith(start)).drop("text", "content").orderBy("path")


def get(docs: DataFrame, path: str | Column) -> DataFrame:
    """The document of a path, which is normalised first."""
    return docs.where(F.col("path") == T.norm_path(F.lit(path) if isinstance(path, str) else path))


def get_many(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (asked) with the documents found by their normalised paths; unknown ones have no row."""
    return asked.withColumn("path", T.norm_path(F.col("asked"))).join(docs, "path")


def summarize(hits: DataFrame, path: str = "path", by: str = "qid", most: int = 5) -> DataFrame:
    """(by, count, paths): how many hits a question has and its first distinct paths, by rank."""
    first = hits.groupBy(by, path).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", F.col(path).alias("p"))))
    return first.groupBy(by).agg(F.sum("n").alias("count"), F.slice(F.transform(ordered, lambda x: x["p"]), 1, most).alias("paths"))
