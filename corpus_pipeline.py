"""From raw documents to token digests: quality rules, line dedup, near-dedup, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet and reads
them again as the next one's input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import bpe, linededup, mixing, nearcopies, quality
from loomspark.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees keep."""
    return quality.quality_rules(docs, table(spark, sf_dir, "labels"), keep_columns=True).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines, and their new lengths."""
    kept = linededup.line_dedup(docs.select(*COLUMNS))
    text = F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(F.col("kept"))
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_dropped") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (5-word Jaccard of 0.8 or more); rows without an id are kept."""
    found = nearcopies.near_components(docs.select("doc_id", "text"))
    first = found.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.select(*COLUMNS).join(first, "doc_id").dropDuplicates(["doc_id"])
    return one.unionByName(docs.select(*COLUMNS).where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix takes of it: none, one or two."""
    mixed = mixing.mix(docs.select(*COLUMNS).withColumn("sources", F.array("source")), keep_text=True).where("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))
    return mixed.withColumn("_", F.explode(times)).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes; small memories, as the executors hold the earlier stages' too."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, states=150_000, words=20_000)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mix_sources),
    ("byte-level bpe", byte_bpe),
]

#: Boosted trees, XXH64 and BPE are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs)
    return docs
