"""Readers of corpora, change lists and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunks


def corpus(spark: SparkSession, root: str, area: str) -> DataFrame:
    """(area, path, text) of every markdown file below ``root``; tool folders are left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("f"), F.col("value").alias("text"))
    # file names are given URL-encoded; a plus is itself there
    name = F.url_decode(F.replace("f", F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/").split(":")[-1].lstrip("/") + "/"
    path = F.substring(name, F.locate(base, name) + len(base), F.length(name))
    found = files.select(F.lit(area).alias("area"), path.alias("path"), "text").where(~F.col("path").rlike(r"(^|/)(node_modules|tools|\.git)/"))
    return found.orderBy("path")


def docs(df: DataFrame, mode: str = "permissive") -> DataFrame:
    """Documents (path, text) with meta, body and ``_error``: a broken head gives an empty meta, or fails the job with mode ``failfast``."""
    return chunks.parsed(df, mode)


def in_doc_dirs(df: DataFrame, dirs=T.DOC_DIRS) -> DataFrame:
    return df.where(F.substring_index("path", "/", 1).isin(*dirs))


def name_status(lines: DataFrame, col: str = "value") -> DataFrame:
    """(status, path, old_path) of name-status lines: a rename keeps its old path, a copy counts as added, other codes as modified."""
    p = F.split(col, "\t")
    code = F.substring(p[0], 1, 1)
    two = code.isin("R", "C") & (F.size(p) > 2)
    status = F.when(code == "C", "A").when(code.isin("A", "M", "D", "R"), code).otherwise("M")
    return lines.where(F.size(p) > 1).select(status.alias("status"), F.when(two, F.get(p, F.lit(2))).otherwise(p[1]).alias("path"), F.when(code == "R", p[1]).alias("old_path"))


def merge_log(lines: DataFrame, col: str = "value") -> DataFrame:
    p = F.split(col, "\t", 2)
    return lines.where(F.size(p) > 1).select(p[0].alias("sha"), p[1].alias("subject"), F.regexp_extract(p[1], r"#(\d+)", 1).try_cast("int").alias("pr"))


def ground_truth(docs: DataFrame, section: str, base: str = "genel", head: str = "Soru") -> DataFrame:
    """(path, text, docs): questions and the documents they want, from the table under ``## section`` of documents (path, body).

    Links are taken relative to ``base``, their anchors cut. Header and rule rows and rows without links are left out.
    """
    body = F.coalesce(F.col("body"), F.lit(""))
    start = F.locate(f"## {section}", body)
    cut = F.when(start > 0, F.substring_index(F.substring(body, start, F.length(body)), "\n## ", 1)).otherwise(F.lit(""))
    cells = docs.select("path", F.explode(F.split(cut, "\n")).alias("line")).select("path", F.transform(F.split("line", r"\|"), lambda c: F.btrim(c)).alias("c")).where(F.size("c") >= 4)
    rows = cells.select("path", F.get("c", F.lit(1)).alias("text"), F.regexp_extract_all(F.get("c", F.lit(2)), F.lit(r"\]\(([^)#]+)"), F.lit(1)).alias("links"))
    rows = rows.where((F.col("text") != head) & ~F.col("text").startswith("---") & (F.size("links") > 0))

    def resolved(x):
        parts = F.filter(F.split(F.concat(F.lit(base + "/"), x), "/"), lambda p: (p != "") & (p != "."))
        up = lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), s), -1) != ".."), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(F.array_append(s, p))
        return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")

    return rows.select("path", "text", F.transform("links", resolved).alias("docs"))


def problems(lines: DataFrame, col: str = "value", limit: int = 12) -> DataFrame:
    """Newest warnings and errors of JSON-lines logs; other and partial lines are skipped."""
    whole = lines.where(F.col(col).startswith("{") & F.try_parse_json(col).isNotNull())
    rows = whole.select(F.from_json(col, "time string, level string, msg string, error string").alias("j")).select("j.*")
    bad = rows.where(F.col("level").isin("warn", "error"))
    return bad.select("time", "level", "msg", F.substring("error", 1, 240).alias("error")).orderBy(F.desc("time"), "msg").limit(limit)


def chunks_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
