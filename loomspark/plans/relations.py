"""The engine's relations, made from the test tables. Each has the same definition in SQL (``CTES``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AREA_STATUS = ("canlıda", "kaldırıldı")
#: Labels up to which they are handed to every task, after a count: else whole texts are shuffled to meet them.
FEW_LABELS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    """(path, key, module, kind, status, title, content, text)."""
    labels = table(spark, d, "labels").select("doc_id", "toxic")
    labels = F.broadcast(labels) if labels.count() <= FEW_LABELS else labels
    rows = table(spark, d, "documents").join(labels, "doc_id", "left")
    return rows.select(
        F.concat(F.lit("flows/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.col("doc_id").alias("key"), F.col("source").alias("module"), F.col("lang").alias("kind"),
        F.when(F.col("toxic") == 1, "kaldırıldı").otherwise("canlıda").alias("status"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "text",
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("path"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "user_id", F.col("event_type").alias("tool"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("props").alias("result"))


def users(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") < 0, F.lit(1)).alias("disabled_at"))


def fixtures(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    made = rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_suppkey") % 20).alias("home"), (F.col("l_partkey") % 20).alias("away"), (F.floor("l_quantity") % 5).alias("home_goals"), (F.col("l_linenumber") % 4).cast("long").alias("away_goals"),
        F.when(F.col("l_linestatus") == "F", "completed").otherwise("open").alias("status"), F.col("l_shipdate").alias("match_date"),
    )
    return made.where("home <> away").groupBy("id").agg(*(F.min(c).alias(c) for c in ("home", "away", "home_goals", "away_goals", "status", "match_date"))).where("home <> away")


def teams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 20).alias("team")).agg(F.min("s_name").alias("name"), F.min("s_nationkey").cast("long").alias("owner"))


def owners(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("owner"), F.col("n_name").alias("name"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()


CTES = {
    "docs": "SELECT 'flows/' || source || '/' || d.doc_id || '.md' AS path, d.doc_id AS key, source AS module, lang AS kind, CASE WHEN toxic = 1 THEN 'kaldırıldı' ELSE 'canlıda' END AS status, string_split(text, chr(10))[1] AS title, text FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "usage_events": "SELECT event_id AS id, ts AS \"at\", user_id, event_type AS tool, CASE WHEN event_type = 'error' THEN 'failed' END AS error, props AS result, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul' AS DATE) AS day FROM events",
    "users": "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 1 END AS disabled_at FROM customer",
    "clock": "SELECT max(ts) AS \"at\", CAST((max(ts) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Istanbul' AS DATE) AS today FROM events",
    "daily": "SELECT day, user_id, tool, count(*) AS calls, count(error) AS errors FROM usage_events WHERE user_id IS NOT NULL GROUP BY ALL",
    "fixtures": "SELECT * FROM (SELECT id, min(home) AS home, min(away) AS away, min(home_goals) AS home_goals, min(away_goals) AS away_goals, min(status) AS status, min(match_date) AS match_date FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 20 AS home, l_partkey % 20 AS away, CAST(floor(l_quantity) AS BIGINT) % 5 AS home_goals, l_linenumber % 4 AS away_goals, CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'open' END AS status, l_shipdate AS match_date FROM lineitem) WHERE home <> away GROUP BY id) WHERE home <> away",
    "sides": "SELECT id, home AS team, away AS opponent, home_goals AS scored, away_goals AS conceded, status, match_date FROM fixtures UNION ALL SELECT id, away, home, away_goals, home_goals, status, match_date FROM fixtures",
    "teams": "SELECT s_suppkey % 20 AS team, min(s_name) AS name, min(s_nationkey) AS owner FROM supplier GROUP BY 1",
    "edges": "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem",
}
NEEDS = {"daily": ("usage_events",), "sides": ("fixtures",)}


def sql(body: str, *names: str, recursive: str = "") -> str:
    """A statement with the relations that it names."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in (*NEEDS.get(n, ()), n) if x not in wanted]
    parts = [f"{n} AS ({CTES[n]})" for n in wanted]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*parts, *([recursive] if recursive else [])])} {body}" if parts or recursive else body
