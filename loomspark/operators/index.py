"""Incremental index: hash diff, embedding only what is new, an upsert of the buckets that changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import buckets, words
from loomspark.sources import manifest
from loomspark.sources.scratch import written

BATCH = 64


def diff(current: DataFrame, ledger: DataFrame, key: str = "id") -> DataFrame:
    """(key, state): added, changed, removed or same, by hash."""
    a, b = current.select(key, F.col("hash").alias("new")), ledger.select(key, F.col("hash").alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") == F.col("old"), "same").otherwise("changed")
    return a.join(b, key, "full").select(key, state.alias("state"))


def missing(current: DataFrame, store: DataFrame) -> DataFrame:
    """Distinct hashes without a stored vector."""
    return current.select("hash").distinct().join(store.select(F.col("key").alias("hash")), "hash", "left_anti")


def retain(store: DataFrame, live: DataFrame) -> DataFrame:
    return store.join(live.select(F.col("hash").alias("key")).distinct(), "key", "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Deterministic bag of words: each word's rolling hash picks a bucket."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        out[:, 0] += 0.01
        for i, t in enumerate(texts):
            for w in pd.Series([t]).str.lower().str.findall(r"\w+").iloc[0]:
                h = 0
                for c in w:
                    h = (h * 31 + ord(c)) & 0xFFFFFFFF
                out[i, h % dim] += 1
        return out

    return embed


def term_vectors(df: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, vec): a bag of words: each term counts in the bucket that its MD5 picks. Texts without terms have no row."""
    rows = words.buckets(df.select(F.col(key).alias("key"), text), T.lowered(F.col(text)), dim).groupBy("key").agg(F.collect_list("vec").alias("rows"))
    # a key has one row, but where it is given more than once
    more = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.get("rows", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return rows.select("key", F.when(F.size("rows") == 1, F.get("rows", F.lit(0))).otherwise(more).cast("array<double>").alias("vec"))


def embed(df: DataFrame, key: str, text: str, embedder: Callable, input_type: str | None = None) -> DataFrame:
    """(key, vec, tokens): a user's function on batches of 64 texts, in their order.

    With ``input_type`` ('document' or 'query') the function gets it as second argument. It returns the vectors, or the vectors and the number of
    tokens of each text; else ``tokens`` is null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                part = pdf.iloc[i : i + BATCH]
                texts = part[text].tolist()
                made = embedder(texts) if input_type is None else embedder(texts, input_type)
                vecs, tokens = made if isinstance(made, tuple) else (made, None)
                yield pd.DataFrame({"key": part[key], "vec": list(np.asarray(vecs, np.float64)), "tokens": pd.Series(tokens if tokens is not None else [None] * len(part), index=part.index, dtype="Int64")})

    return df.select(key, text).mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, vec array<double>, tokens long")


def embed_questions(questions: DataFrame, embedder: Callable, known: DataFrame | None = None, input_type: str | None = None) -> DataFrame:
    """(qid, vec) of questions (qid, text): a text that is asked again, or whose hash is known (key, vec), is not embedded again."""
    asked = questions.select("qid", "text", T.sha(F.col("text")).alias("key"))
    todo = asked.groupBy("key").agg(F.first("text").alias("text"))
    if known is not None:
        todo = todo.join(known.select("key"), "key", "left_anti")
    made = embed(todo, "key", "text", embedder, input_type).select("key", "vec")
    return asked.join(made if known is None else made.unionByName(known.select("key", "vec")), "key").select("qid", "vec")


#: Raised when the layout of the state folder changes, which forces a pass.
SCHEMA = "3"


def sync(current: DataFrame, state: str, embedder: Callable, commit: str, model: str = "", dimension: int = 0, docs: DataFrame | None = None, expect: int | None = None) -> dict[str, int]:
    """One idempotent step over a state folder of ``buckets``: embeds missing hashes, brings the ledger up to date, drops dead vectors, and commits all at once.

    ``current``: (id, hash, embed_text). Only the buckets of changed rows are written anew; the manifest that names them is the stamp, and a writer that was
    overtaken since it read (or since version ``expect``) raises ``LostRace`` and has changed nothing. Another model or dimension than the stamp's makes
    everything anew (``rebuilt``). Vectors stay if only the ledger is lost. With ``docs`` (path, hash, ...) the full documents are stored too, and counted as
    ``docs_written`` and ``docs_removed``.
    """
    spark = current.sparkSession
    version, content = manifest.read(spark, state, expect)
    stamp = content.get("note", {})
    rebuilt = bool(version and (stamp.get("model", ""), stamp.get("dimension", 0)) != (model, dimension))
    shapes = {"ledger": "id string, hash string", "store": "key string, vec array<double>"}
    known = {n: spark.createDataFrame([], s) if rebuilt else buckets.table(spark, state, n, version, s) for n, s in shapes.items()}
    states = written(diff(current, known["ledger"]))
    counts = {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    todo = missing(current, known["store"]).join(current.select("hash", "embed_text").dropDuplicates(["hash"]), "hash")
    made = embed(todo, "hash", "embed_text", embedder).select("key", "vec")
    changed = current.select("id", "hash").join(states.where("state in ('added', 'changed')").select("id"), "id", "left_semi")
    dead = known["store"].select("key").join(current.select(F.col("hash").alias("key")), "key", "left_anti")
    changes = {
        "ledger": buckets.Change("id", changed, states.where("state = 'removed'").select("id"), rebuilt),
        "store": buckets.Change("key", made, dead, rebuilt),
    }
    out = {k: counts.get(k, 0) for k in ("added", "changed", "removed", "same")}
    if docs is not None:
        old = buckets.table(spark, state, "docs", version, _ddl(docs))
        old = spark.createDataFrame([], old.schema) if rebuilt else old
        told = written(diff(docs, old, "path"))
        moved = {r.state: r.n for r in told.groupBy("state").agg(F.count("*").alias("n")).collect()}
        new = docs.join(told.where("state in ('added', 'changed')").select("path"), "path", "left_semi")
        changes["docs"] = buckets.Change("path", new, told.where("state = 'removed'").select("path"), rebuilt)
        out |= {"docs_written": moved.get("added", 0) + moved.get("changed", 0), "docs_removed": moved.get("removed", 0)}
    buckets.change(spark, state, changes, {"commit": commit, "schema": SCHEMA, "model": model, "dimension": dimension}, version)
    return out | ({"rebuilt": 1} if rebuilt else {})


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
