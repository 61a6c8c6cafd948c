"""Operators on small inline fixtures."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunks, graph, impact, index, policy, quality, search
from loomspark.sources import corpus


def col(spark, values, f):
    return [r.y for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def test_scalars(spark):
    assert col(spark, ["PVP_LIMIT nedir? İstek, istek"], T.question_terms) == [["pvp_limit", "istek"]]
    assert col(spark, ["./a/b", " /x.md"], T.norm_path) == ["a/b.md", "x.md"]
    assert col(spark, ["a  b\nc", "abcdef"], lambda c: T.one_line(c, 5)) == ["a b c", "abcd…"]
    assert col(spark, ["[a](x%20y.md#z) [b](http://q) [c](#d) [e](a+b.md?r)"], T.links) == [["x y.md", "a+b.md"]]
    assert col(spark, ["a<!-- gen:start -->B<!-- gen:end -->c", "none"], T.gen_block) == ["B", None]
    assert col(spark, ["secret-1234", "abc", ""], T.mask_secret) == ["…1234", "••••", None]
    assert col(spark, ["fooBar Baz", "HTTPServer", "getUserByID"], T.kebab) == ["foo-bar baz", "http-server", "get-user-by-id"]
    assert col(spark, ["aa\n\nbb\n\ncccc"], lambda c: T.pack(c, 6)) == [["aa\n\nbb", "cccc"]]


def test_sections_and_frontmatter(spark):
    md = "---\ntype: flow\n---\n# T\nintro\n## A\nx\n```\n## no\n```\n### B\ny\n## C\n"
    d = chunks.frontmatter(spark.createDataFrame([("p", md), ("q", "plain")], "path string, text string"))
    assert {r.path: r["head"] for r in d.collect()} == {"p": "type: flow", "q": None}
    got = {(r.path, r.h2, r.h3): r.text for r in chunks.sections(d).collect()}
    assert got == {("p", "", ""): "intro", ("p", "A", ""): "x\n```\n## no\n```", ("p", "A", "B"): "y", ("q", "", ""): "plain"}


def test_ranking(spark):
    lists = spark.createDataFrame([("q", 0, 1.0, "a", 0), ("q", 0, 1.0, "b", 1), ("q", 1, 2.0, "b", 0), ("q", 1, 2.0, "c", 1)], "qid string, list int, weight double, key string, rank int")
    got = [r.key for r in search.rrf(lists, 20).orderBy(F.desc("score")).collect()]
    assert got == ["b", "c", "a"]


def test_name_status(spark):
    lines = spark.createDataFrame([("M\ta",), ("R100\ta\tb",), ("C75\ta\tc",), ("T\td",)], "value string")
    assert [tuple(r) for r in corpus.name_status(lines).collect()] == [("M", "a", None), ("R", "b", "a"), ("A", "c", None), ("M", "d", None)]
    kept = impact.relevant(corpus.name_status(lines).union(spark.createDataFrame([("M", "x.spec.ts", None), ("R", "y.md", "y.ts")], "status string, path string, old_path string")))
    assert {r.path for r in kept.collect()} == {"a", "b", "c", "d", "y.md"}


def test_groups(spark):
    rows = [(f"flows/a/{i}.md",) for i in range(3)] + [(f"flows/b/{i}.md",) for i in range(2)] + [("genel/x.md",)]
    got = {r.doc: r.group for r in impact.plan_groups(spark.createDataFrame(rows, "doc string"), 4).collect()}
    assert got["flows/a/0.md"] == 0 and got["flows/b/1.md"] == 1


def test_policy(spark):
    p = policy.Policy({"t": policy.TablePolicy("t", columns=("id", "who"))}, key="id")
    with pytest.raises(policy.QueryRefused):
        p.check("a.userToken.b")
    df = spark.createDataFrame([(1, ("x", "s"), [1] * 70)], "id int, who struct<name:string,token:string>, xs array<int>")
    out = policy.Policy({}, key="id").redact(df)
    assert out.columns == ["id", "who", "xs", "xs_more"] and out.schema["who"].dataType.names == ["name"]
    r = out.first()
    assert len(r.xs) == 60 and r.xs_more == 10
    assert p.project(p.redact(df, "t"), "t", ["xs"]).columns == ["id"]


def test_graph_cycles(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (5, 6)], "src long, dst long")
    assert {r.node for r in graph.reachable(e, spark.createDataFrame([(0,)], "node long")).collect()} == {0, 1, 2}


def test_added_lines(spark):
    b = spark.createDataFrame([("p", 0, "x")], "path string, pos int, line string")
    a = spark.createDataFrame([("p", 0, "x"), ("p", 1, "x"), ("p", 2, "y")], "path string, pos int, line string")
    assert {(r.pos, r.line) for r in quality.added_lines(b, a).collect()} == {(1, "x"), (2, "y")}


def test_sync_is_idempotent(spark, tmp_path):
    cur = spark.createDataFrame([("a", "h1", "one"), ("b", "h2", "two")], "id string, hash string, embed_text string")
    one = index.sync(cur, f"{tmp_path}/s", index.hash_embedder(8), "c1")
    two = index.sync(cur, f"{tmp_path}/s", index.hash_embedder(8), "c2")
    three = index.sync(cur.where("id = 'a'"), f"{tmp_path}/s", index.hash_embedder(8), "c3")
    assert one["added"] == 2 and two == {"added": 0, "changed": 0, "removed": 0, "same": 2} and three["removed"] == 1
