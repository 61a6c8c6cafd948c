"""Sections cut where their text stands, against windows over lines."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspark.operators import chunks


def by_windows(df):
    """(path, section, h2, h3, text): lines numbered, fences by the parity of a running count, headings the last ones seen."""
    lines = df.select("path", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").startswith("```").cast("int")
    lines = lines.withColumn("fenced", (F.sum(fence).over(w) % 2 == 1) | (fence == 1))
    level = F.when(~F.col("fenced"), F.length(F.regexp_extract("line", r"^(#{1,3})\s", 1))).otherwise(0)
    lines = lines.withColumn("level", level).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    title = F.trim(F.regexp_replace("line", r"^#{1,3}\s+", ""))
    top = F.last(F.when(F.col("level") == 1, F.lit("")).when(F.col("level") == 2, title), ignorenulls=True).over(w)
    sub = F.last(F.when(F.col("level").isin(1, 2), F.lit("")).when(F.col("level") == 3, title), ignorenulls=True).over(w)
    lines = lines.withColumn("h2", F.coalesce(top, F.lit(""))).withColumn("h3", F.coalesce(sub, F.lit("")))
    out = lines.where("level = 0").groupBy("path", "section", "h2", "h3").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return out.select("path", "section", "h2", "h3", F.btrim(F.array_join(F.col("l.line"), "\n"), F.lit(" \n\t\r")).alias("text")).where("text <> ''")


LINES = ["", "text", "  ", "# a", "## b ", "##\tc ", "###  d\r", "#### e", "##", "## ", "#x", " ## f", "```", "```mermaid", "x ```", "### g", "\x0b", "##\x0ch", "é\r"]


def frame(spark):
    rng = random.Random(5)
    rows = [(f"p{i}", "\n".join(rng.choice(LINES) for _ in range(rng.randint(1, 14)))) for i in range(300)] + [("n", None), ("e", "")]
    return spark.createDataFrame(rows, "path string, body string").withColumn("kind", F.concat(F.lit("of "), "path"))


def test_sections_are_those_of_windows(spark):
    df, cols = frame(spark), ("path", "section", "h2", "h3", "text")
    rows = lambda d: sorted(map(tuple, d.select(*cols).collect()))
    want = rows(by_windows(df))
    assert len(want) > 300 and rows(chunks.sections(df)) == want
    assert all(r.kind == f"of {r.path}" for r in chunks.sections(df, carry=("kind",)).collect())
    assert chunks.sections(df.limit(0)).count() == 0


def test_chunks_stay_where_their_text_stands(spark):
    """Texts went through a shuffle of lines, and were read a second time for the columns beside them."""
    df = frame(spark).select("path", F.col("body").alias("text"))
    plan = chunks.build_chunks(chunks.parsed(df))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("ArrowEvalPython") == 1


def test_heads_by_either_parser():
    import pandas as pd
    import yaml

    heads = ["title: a\naliases: [x, y]", "a: [", "- 1\n- 2", "just text", "", None, "a: 'b", "k: é\nn: 3", "a: b: c", "d: 2024-01-02"]
    got = next(chunks.front_json([pd.Series(heads)])).values.tolist()
    fast = yaml.__dict__.pop("CSafeLoader", None)
    try:
        assert got == next(chunks.front_json([pd.Series(heads)])).values.tolist()
    finally:
        if fast:
            yaml.CSafeLoader = fast
