"""Corpus checks; each gives (rule, severity, path, message)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T


def _found(df: DataFrame, rule: str, severity: str, path, message) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), path.alias("path"), message.alias("message"))


def unique_ids(chunks: DataFrame) -> DataFrame:
    twice = chunks.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    return _found(twice, "unique-id", "retryable", F.col("id"), F.concat(F.lit("chunk id occurs "), F.col("n").cast("string"), F.lit(" times")))


def leftover_diagrams(chunks: DataFrame) -> DataFrame:
    """Chunks (id, embed_text) that still hold a diagram."""
    return _found(chunks.where(F.col("embed_text").contains("```mermaid")), "diagram", "retryable", F.col("id"), F.lit("diagram in the embedded text"))


def aliases_are_lists(docs: DataFrame) -> DataFrame:
    """Documents (path, meta) whose aliases are there but no list."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("meta"), "$.aliases", "variant"))
    return _found(docs.where(kind.isNotNull() & (kind != "VOID") & ~kind.startswith("ARRAY")), "aliases", "retryable", F.col("path"), F.lit("aliases must be a list"))


def scope(changes: DataFrame, area: str, managed: tuple[str, ...] = ("README.md",)) -> DataFrame:
    """Changes (status, path) that may not be made: outside the area, no markdown, documents that others manage, and deletions."""
    inside = F.col("path").startswith(f"{area}/") & F.col("path").endswith(".md")
    own = F.col("path").isin(*(f"{area}/{m}" for m in managed))
    why = F.when(F.col("status") == "D", "deleted: mark it as removed instead").when(~inside, "file that may not be changed").when(own, "document that is managed elsewhere")
    return _found(changes.withColumn("why", why).where("why is not null"), "scope", "fatal", F.col("path"), F.col("why"))


def vocabulary(docs: DataFrame, allowed: list[str]) -> DataFrame:
    """Documents with a status that is not allowed; one without a status passes."""
    return _found(docs.where(~F.col("status").isin(allowed)), "status", "retryable", F.col("path"), F.concat(F.lit("status: "), "status"))


def broken_links(links: DataFrame, targets: DataFrame) -> DataFrame:
    """links: (path, link), targets: (target). Links are resolved against their document's folder."""
    base = T.dirname(F.col("path"))
    full = F.when(F.col("link").startswith("/"), F.substring("link", 2, 1 << 30)).otherwise(F.concat_ws("/", F.nullif(base, F.lit("")), "link"))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    up = lambda s, p: F.when((p == "..") & (F.size(s) > 0) & (F.coalesce(F.element_at(F.concat(F.array(F.lit("")), s), -1), F.lit("")) != ".."), F.slice(s, F.lit(1), F.size(s) - 1)).otherwise(F.array_append(s, p))
    resolved = links.select("path", "link", F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/").alias("target"))
    return _found(resolved.join(targets, "target", "left_anti"), "broken-link", "retryable", F.col("path"), F.col("link"))


def dangling(docs: DataFrame, files: DataFrame) -> DataFrame:
    """``sources`` and ``models`` that are not among the files (file); removed documents are left out."""
    live = docs.where("status is null or status <> 'kaldırıldı'")
    return _dangling(live, files, [c for c in ("sources", "models") if c in docs.columns])


def dangling_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``related``, ``api``, ``metrics`` and ``backend`` that are not among the known documents (file), removed or not."""
    return _dangling(docs, known, [c for c in ("related", "api", "metrics", "backend") if c in docs.columns])


def _dangling(docs: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    lists = F.flatten(F.array(*(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("kind"), x.alias("file"))) for c in columns)))
    named = docs.select("path", F.explode(lists).alias("x")).select("path", "x.kind", "x.file")
    gone = named.join(files.select("file").distinct(), "file", "left_anti")
    return _found(gone, "dangling", "retryable", F.col("path"), F.concat_ws(": ", "kind", "file"))


def todo(docs: DataFrame, marker: str = "TODO") -> DataFrame:
    return _found(docs.where(F.col("text").contains(marker)), "todo", "retryable", F.col("path"), F.lit(marker))


def added_lines(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines (path, line) of ``after`` beyond as many as ``before`` has: a multiset difference."""
    n = F.row_number().over(Window.partitionBy("path", "line").orderBy("pos"))
    old = before.groupBy("path", "line").agg(F.count("*").alias("had"))
    return after.withColumn("nth", n).join(old, ["path", "line"], "left").where(F.col("nth") > F.coalesce("had", F.lit(0))).select("path", "pos", "line")


def size_brake(edited: int, affected: int) -> bool:
    return edited > max(10, 3 * affected)


def run(rules: list[DataFrame]) -> DataFrame:
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out.distinct()


def live_links(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (path, ...) of documents that are not removed; a document without a status stays."""
    return links.join(docs.where(F.col("status").eqNullSafe(F.lit("kaldırıldı"))).select("path"), "path", "left_anti")


def document_links(docs: DataFrame) -> DataFrame:
    """(path, link): every relative link of each document (path, text)."""
    return docs.select("path", F.explode(T.links(F.col("text"))).alias("link"))


def folder_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.substring_index("path", "/", 2).alias("folder")).agg(F.count("*").alias("n"))


def gen_block(docs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Generated blocks that differ from the snapshot's (path, block), and documents with a block that it does not know."""
    own = docs.select("path", T.gen_block(F.col("text")).alias("own")).where("own is not null")
    rows = own.join(snapshot.select("path", "block", F.lit(True).alias("known")), "path", "left")
    changed = F.when(F.col("known").isNull(), "unknown generated document").when(~F.col("own").eqNullSafe(F.col("block")), "generated block changed")
    return _found(rows.withColumn("why", changed).where("why is not null"), "gen-block", "retryable", F.col("path"), F.col("why"))


def secrets(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Added lines (path, line) that match a secret's pattern; the message is the pattern's name, never the line."""
    kinds = F.array_compact(F.array(*(F.when(F.col("line").rlike(p), F.lit(name)) for name, p in patterns.items())))
    return _found(lines.select("path", F.explode(kinds).alias("kind")).distinct(), "secret", "fatal", F.col("path"), F.col("kind"))


def unknown_names(lines: DataFrame, words: DataFrame, historical: str) -> DataFrame:
    """Identifiers in added lines (path, line) that are not among ``words`` (word); lines of past wording are exempt."""
    named = lines.where(~F.col("line").rlike(historical)).select("path", F.explode(T.identifiers(F.col("line"))).alias("word")).distinct()
    return _found(named.join(words.select("word").distinct(), "word", "left_anti"), "unknown-name", "retryable", F.col("path"), F.col("word"))


def coverage(named: DataFrame, texts: DataFrame) -> DataFrame:
    """Names (path, name) that no text mentions as a word."""
    seen = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\w+)"), F.lit(1)))).alias("name")).distinct()
    return _found(named.join(seen, "name", "left_anti"), "coverage", "retryable", F.col("path"), F.col("name"))


def stamp_only(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path) of documents with a generated block whose change is in the commit stamp alone."""
    rows = after.join(before.select("path", F.col("text").alias("old")), "path").where(F.col("text") != F.col("old"))
    return rows.where(T.gen_block(F.col("text")).isNotNull() & (T.without_stamp(F.col("text")) == T.without_stamp(F.col("old")))).select("path")
