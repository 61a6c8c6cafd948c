"""Chunks, stored documents, impact, guarded access and the smaller operators on inline fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import chunks, facts, graph, impact, index, layout, policy, quality, search, store, usage, views
from loomspark.sources import corpus
from loomspark.streaming import rollup as streams

FLOW = "---\ntype: flow\nmodule: pvp\ntitle: Daily right\naliases: [hak, limit]\n---\n# Daily right\nintro\n\n## Rules\n```mermaid\ngraph\n## no heading\n```\nafter\n\n\n\nmore\n### Detail\n| a | b |\n|---|---|\n" + "\n".join(f"| row {i} | {'x' * 60} |" for i in range(60))
CARD = "---\nname: Join\n---\n# Join\n## Ne yapar\nIt joins.\n## Else\nother\n<!-- gen:start -->\n## Ne yapar\ngenerated\n<!-- gen:end -->\n"


def col(spark, values, f):
    return [r.y for r in spark.createDataFrame(list(enumerate(values)), "i int, x string").orderBy("i").select(f(F.col("x")).alias("y")).collect()]


def corpus_of(spark, mode="permissive"):
    rows = [("flows/pvp/daily.md", FLOW), ("usecases/pvp/join.md", CARD), ("genel/broken.md", "---\na: [1\n---\ntext"), ("genel/list.md", "---\n- 1\n---\ntext"), ("genel/plain.md", "no head"), ("genel/empty.md", None)]
    return corpus.docs(spark.createDataFrame(rows, "path string, text string"), mode)


def test_lenient_and_strict_loading(spark):
    got = {r.path: (r.meta, r.body, r._error is not None) for r in corpus_of(spark).collect()}
    assert got["genel/broken.md"] == ("{}", "---\na: [1\n---\ntext", True) and got["genel/list.md"][2]
    assert got["genel/plain.md"] == ("{}", "no head", False) and got["genel/empty.md"] == ("{}", None, False)
    with pytest.raises(Exception, match="frontmatter"):
        corpus_of(spark, "failfast").collect()


def test_heads_without_a_yaml_library():
    assert chunks.plain_head("type: flow\nn: 3\naliases: [a, 'b c']\nsources:\n  - x.ts\n  - y.ts\n# no\nempty:\n") == {"type": "flow", "n": 3, "aliases": ["a", "b c"], "sources": ["x.ts", "y.ts"], "empty": None}
    assert chunks.plain_head("- 1\n- 2") == [1, 2] and chunks.plain_head("") is None
    for broken in ("a: [1", "no colon"):
        with pytest.raises(ValueError, match="not understood"):
            chunks.plain_head(broken)


def test_chunks(spark):
    rows = {r.id: r for r in chunks.build_chunks(corpus_of(spark), "Frontend").collect()}
    assert {"flows/pvp/daily.md#giriş", "flows/pvp/daily.md#Rules", "flows/pvp/daily.md#Rules › Detail#1", "flows/pvp/daily.md#Rules › Detail#2", "usecases/pvp/join.md#Ne yapar"} <= set(rows)
    rules = rows["flows/pvp/daily.md#Rules"]
    assert rules.embed_text == "Frontend · Akış (pvp) › Daily right › Rules\nEş anlamlılar: hak, limit\nafter\n\nmore"
    assert "mermaid" in rules.text and rules.kind == "flow"
    assert rows["flows/pvp/daily.md#Rules › Detail#2"].text.startswith("| a | b |\n|---|---|\n| row")
    card = rows["usecases/pvp/join.md#Ne yapar"]
    assert (card.kind, card.text, card.embed_text) == ("usecase", "It joins.", "Frontend · Use case kartı › Join › Ne yapar\nIt joins.")
    assert [i for i in rows if i.startswith("usecases")] == ["usecases/pvp/join.md#Ne yapar"]


def test_stored_documents(spark):
    rows = {r.path: r for r in store.doc_rows(corpus_of(spark)).collect()}
    assert (rows["flows/pvp/daily.md"].kind, rows["usecases/pvp/join.md"].kind, rows["genel/plain.md"].kind, rows["genel/plain.md"].title) == ("flow", "usecase", "", "plain")
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, hash string")
    assert {(r.path, r.state) for r in store.sync_docs(new, old).collect()} == {("a", "same"), ("b", "written"), ("c", "removed"), ("d", "written")}
    assert {tuple(r) for r in store.apply_docs(new, old).collect()} == {("a", "1"), ("b", "9"), ("d", "4")}
    shown = store.hit_row(store.index_row(spark.createDataFrame([(["x", "y"], ["A", "B"], None, 0.123456)], "aliases array<string>, headings array<string>, status string, score double"))).first()
    assert (shown.aliases, shown.headings, shown.status, shown.score) == ("x, y", "A › B", "", 0.1235)
    assert store.get(store.doc_rows(corpus_of(spark)), "./genel/plain").count() == 1
    assert [r.path for r in store.list_docs(store.doc_rows(corpus_of(spark)), "./genel/p").collect()] == ["genel/plain.md"]


def test_functions(spark):
    assert col(spark, ["`UserUseCase` `A_B` ` PlayGuard ` `module` `FooEntity`"], T.identifiers) == [["UserUseCase", "A_B", "PlayGuard"]]
    assert col(spark, ["`attrFactor` `Attr.DribbleFactor` `shift()` `Not ok`"], T.mixed_identifiers) == [["attrFactor", "DribbleFactor"]]
    assert col(spark, ['[a](x.md "title") [b](../y.md#z)'], T.links) == [["x.md", "../y.md"]]
    assert col(spark, ["export declare const abcd = 1; export var nope; export class Abc {} export type Long = 1"], T.exported_names) == [["abcd", "Long"]]
    assert col(spark, ['["a", 1, "b"]', '{"a": 1}', None], T.string_list) == [["a", "b"], [], []]
    assert col(spark, ['{"query": 5, "path": " p "}', "{}"], T.asked) == ["p", ""]
    assert col(spark, ['{"query": "q", "limit": 5, "kind": "flow", "x": null}'], T.other_inputs) == ["limit=5 kind=flow"]
    assert col(spark, ["src/modules/pvp/usecases/deep/join.ts", "src/modules/pvp/usecases/a.spec.ts", "src/x.ts"], T.is_usecase) == [True, False, False]
    assert col(spark, ["src/modules/pvp/usecases/deep/join.ts"], T.card_path) == ["usecases/pvp/join.md"]
    assert col(spark, ["modules/a.md", "usecases/x/y.md", "flows/z/q.md", "genel/sub/x.md", "api/a.md"], T.group_key) == ["a", "x", "flows/z", "genel", "api"]
    assert col(spark, ["x```mermaid a```y\n\n\n\nz\n<!-- gen:start -->\nq"], T.strip_blocks) == ["xy\n\nz\nq"]
    assert col(spark, ["abc"], lambda c: T.render_json(F.struct(c.alias("a")), 5)) == ['{"a":\n… (11 characters, cut)']
    day = spark.range(1).select(T.day_text(F.lit("2024-03-05").cast("date")).alias("a"), T.day_text(F.lit("2024-03-05").cast("date"), True).alias("b")).first()
    assert tuple(day) == ("2024-03-05", "05.03.2024")


def test_job_groups(spark):
    docs = ["flows/a/1.md", "flows/a/2.md", "modules/m.md", "usecases/m/x.md", "flows/b/1.md", "genel/sub/g.md", "genel/h.md"]
    rows = spark.createDataFrame([(x,) for x in docs], "doc string")
    got = {r.doc: r.group for r in impact.plan_groups(rows, 3).collect()}
    assert got == {"flows/a/1.md": 0, "flows/a/2.md": 0, "flows/b/1.md": 0, "modules/m.md": 1, "usecases/m/x.md": 1, "genel/sub/g.md": 2, "genel/h.md": 2}
    assert {r.group for r in impact.plan_groups(rows, 7).collect()} == {0}


CHANGE = "status string, path string, old_path string"


def test_server_impact(spark):
    docs = spark.createDataFrame(
        [("flows/pvp/a.md", ["src/modules/pvp/x.service.ts"], "pvp", "uses MAX_DAILY here"), ("modules/pvp.md", [], "pvp", ""), ("modules/gone.md", [], "gone", ""), ("genel/altyapi.md", [], None, ""), ("genel/genel-bakis.md", [], None, ""), ("usecases/pvp/join.md", [], None, "<!-- gen:start -->MAX_DAILY<!-- gen:end -->"), ("usecases/pvp/left.md", [], None, "")],
        "path string, sources array<string>, module string, body string",
    )
    changes = spark.createDataFrame([("R", "src/modules/pvp/y.service.ts", "src/modules/pvp/x.service.ts"), ("M", "src/modules/pvp/p.resolver.ts", None), ("A", "src/modules/pvp/usecases/new.ts", None), ("M", "src/modules/pvp/usecases/join.ts", None), ("D", "src/modules/pvp/usecases/left.ts", None), ("D", "src/modules/gone/z.ts", None), ("A", "src/modules/fresh/z.ts", None), ("M", ".env.example", None)], CHANGE)
    there = spark.createDataFrame([("pvp",), ("fresh",)], "module string")
    got = {r.doc: r.reasons for r in impact.compute(changes, docs, existing=there, names=spark.createDataFrame([("MAX_DAILY",)], "name string")).collect()}
    assert got["flows/pvp/a.md"] == ["sources: moved: src/modules/pvp/x.service.ts → src/modules/pvp/y.service.ts", "endpoint changed: src/modules/pvp/p.resolver.ts", "name: MAX_DAILY"]
    assert got["modules/pvp.md"] == ["endpoint changed: src/modules/pvp/p.resolver.ts"] and got["modules/gone.md"] == ["module removed from the code"]
    assert got["genel/genel-bakis.md"] == ["new modules: fresh"] and got["genel/altyapi.md"] == ["category: .env.example"]
    assert got["usecases/pvp/join.md"] == ["card made anew: check what it does"] and got["usecases/pvp/left.md"] == ["use case removed: mark it as removed"] and got["usecases/pvp/new.md"] == ["new card: fill in what it does"]
    assert {(r.module, r.state) for r in impact.modules(changes, there, docs).collect()} == {("pvp", "known"), ("gone", "removed"), ("fresh", "new")}
    assert [r.module for r in impact.card_modules(changes, there).collect()] == ["pvp"]
    assert impact.compute(changes.limit(0), docs).count() == 0


def test_app_and_engine_impact(spark):
    docs = spark.createDataFrame([("flows/a.md", ["src/a/x.ts"], ["api/op.md"], None, ["metrikler/pace.md"]), ("modules/m.md", ["src/a/x.ts"], [], None, []), ("genel/analitik.md", [], [], None, []), ("genel/metriklerin-etkisi.md", [], [], ["analysis/out/m.json"], []), ("api/op.md", [], [], None, [])], "path string, sources array<string>, api array<string>, models array<string>, metrics array<string>")
    changes = spark.createDataFrame([("M", "src/a/x.ts", None), ("A", "src/a/new.tsx", None), ("A", "src/b/new.tsx", None), ("M", "src/lib/analytics/e.ts", None)], CHANGE)
    cards = spark.createDataFrame([("api/op.md", False), ("ekranlar/home.md", True), ("metrikler/pace.md", True), ("genel/oyun-stilleri.md", False)], "path string, fresh boolean")
    app = {r.doc: r.reasons for r in impact.compute(changes, docs, "app", generated=cards).collect()}
    assert app == {"flows/a.md": ["sources: M src/a/x.ts", "new file in a known folder: src/a/new.tsx", "uses what changed: api/op.md"], "genel/analitik.md": ["category: src/lib/analytics/e.ts"], "api/op.md": ["card made anew: check its paragraph"], "ekranlar/home.md": ["new card: fill in its paragraph"]}
    more = spark.createDataFrame([("D", "analysis/out/m.json", None), ("M", "internal/ai/attr.go", None)], CHANGE)
    engine = {r.doc: r.reasons for r in impact.compute(more, docs, "engine", generated=cards).collect()}
    assert engine["genel/metriklerin-etkisi.md"] == ["sources: D analysis/out/m.json", "category: internal/ai/attr.go", "generated table changed: genel/oyun-stilleri.md"]
    assert engine["flows/a.md"] == ["uses what changed: metrikler/pace.md"] and engine["metrikler/pace.md"] == ["new card: fill in its paragraph"]


def test_guarded_access(spark):
    p = policy.Policy({"t": policy.TablePolicy("t", columns=("_id", "name", "n")), "closed": policy.TablePolicy("c", joinable=False)}, key="_id")
    df = spark.createDataFrame([(f"{i:024X}", f"n{i}", i, ("a", f"s{i}"), "secret") for i in range(80)], "_id string, name string, n int, who struct<nick:string,token:string>, password string")
    assert p.count(df, F.col("n") >= 70).first().n == 10
    for query in (lambda: p.count(df, F.col("password") == "secret"), lambda: p.find(df, "t", F.col("who.token") == "s1"), lambda: p.find(df, "t", sort=["password"]), lambda: p.aggregate(df, "t", ["who"], [F.count("*")]), lambda: p.join(df, df, "closed", "_id"), lambda: p.union(df, df, "unknown")):
        with pytest.raises(policy.QueryRefused):
            query()
    assert p.find(df, "t", F.col("n") < 5, sort=[F.desc("n")]).first().n == 4 and p.find(df, "t", limit=500).count() == 80
    assert p.sample(df, 500, seed=1).count() == 50 and "password" not in p.sample(df).columns
    assert p.union(df.select("name"), df.select("name", "password"), "t").columns == ["name"]
    got = {r.path: r.types for r in p.fields(spark.createDataFrame([(1, None, [(1, "x")]), (2, "a", [])], "a int, b string, xs array<struct<k:int,token:string>>")).collect()}
    assert got["a"] == ["int"] and sorted(got["b"]) == ["null", "string"] and got["xs"] == ["array"] and set(got) == {"a", "b", "xs", "xs[]", "xs[].k"}
    ids = spark.createDataFrame([("ABCDEFABCDEFABCDEFABCDEF", bytearray(range(12)), "KEEP")], "_id string, teamId binary, name string")
    assert tuple(p.normalize_ids(ids).first()) == ("abcdefabcdefabcdefabcdef", bytes(range(12)).hex(), "KEEP")


def test_league_views(spark):
    leagues = spark.createDataFrame([(1, "old", ["a", "b", "a"], 1), (2, "new", ["b"], 2)], "id int, name string, team_ids array<string>, started_at int")
    assert {(r.team, r.name) for r in views.latest_league(leagues).collect()} == {("a", "old"), ("b", "new")}
    fixtures = spark.createDataFrame([(1, "a", "b", 1, 0, "completed", 5), (2, "b", "z", None, None, "open", 6)], "id int, home string, away string, home_goals int, away_goals int, status string, match_date int")
    kept = spark.createDataFrame([(1, "v1", 7), (1, "v2", 8)], "fixture int, engine_version string, seed int")
    got = {r.id: (r.home_name, r.away_name, r.engine_version, r.seed) for r in views.match_detail(fixtures, spark.createDataFrame([("a", "A"), ("b", "B")], "team string, name string"), kept).collect()}
    assert got == {1: ("A", "B", "v2", 8), 2: ("B", None, None, None)}


def test_facts_and_graph(spark):
    docs = spark.createDataFrame([(f"{d}/x{i}.md", s, "uses `op` and ``` `op`") for i in range(3) for d, s in (("api", None), ("flows", "canlıda"), ("genel", "kaldırıldı"), ("modules", "canlıda"))], "path string, status string, body string")
    got = [r.path for r in facts.docs_naming(spark.createDataFrame([("op",), ("none",)], "field string"), docs).orderBy("place").collect()]
    assert got == ["flows/x0.md", "flows/x1.md", "flows/x2.md", "modules/x0.md", "modules/x1.md", "modules/x2.md"]
    gap = facts.gaps(spark.createDataFrame([("a",), ("b",)], "field string"), spark.createDataFrame([("q", "a"), ("q", "z")], "op string, field string"))
    assert {tuple(r) for r in gap.collect()} == {("unused", "b", None), ("missing", "z", "q")}
    assert [r.path for r in facts.orphans(spark.createDataFrame([("api/a.md", "a"), ("api/b.md", "b")], "path string, subject string"), spark.createDataFrame([("a",)], "subject string")).collect()] == ["api/b.md"]
    nav = facts.navigation(spark.createDataFrame([("a.tsx", "router.push('/home'); <Link href={'/a/${x}'}>; track('open_it'); router.push(\"/home\")"), ("b.tsx", "none"), ("c", None)], "path string, content string")).collect()
    assert [(r.path, r.targets, r.events) for r in nav] == [("a.tsx", ["/a/", "/home"], ["open_it"])]
    edges = spark.createDataFrame([("layout", "c"), ("screen", "a"), ("a", "b"), ("b", "a"), ("layout", "b")], "src string, dst string")
    roots = spark.createDataFrame([("layout", True), ("screen", False)], "node string, layout boolean")
    got = {(r.node, r.root) for r in graph.roots_reaching(edges, roots, spark.createDataFrame([("b",), ("c",), ("nowhere",)], "node string")).collect()}
    assert got == {("b", "screen"), ("c", "layout")}


def test_checks(spark):
    changes = spark.createDataFrame([("M", "area/flows/a.md"), ("M", "area/README.md"), ("M", "other/x.md"), ("A", "area/x.ts"), ("D", "area/flows/b.md")], "status string, path string")
    assert {r.path for r in quality.scope(changes, "area").collect()} == {"area/README.md", "other/x.md", "area/x.ts", "area/flows/b.md"}
    docs = spark.createDataFrame([("a.md", "canlıda", ["x.ts", "y.ts"], ["b.md"], '{"aliases": ["x"]}'), ("b.md", "kaldırıldı", ["gone.ts"], ["gone.md"], '{"aliases": "x"}'), ("c.md", None, None, None, "{}")], "path string, status string, sources array<string>, related array<string>, meta string")
    known = lambda *x: spark.createDataFrame([(v,) for v in x], "file string")
    assert {(r.path, r.message) for r in quality.dangling(docs, known("x.ts")).collect()} == {("a.md", "sources: y.ts")}
    assert {(r.path, r.message) for r in quality.dangling_documents(docs, known("b.md")).collect()} == {("b.md", "related: gone.md")}
    assert [r.path for r in quality.aliases_are_lists(docs).collect()] == ["b.md"]
    assert [r.path for r in quality.vocabulary(docs, ["canlıda"]).collect()] == ["b.md"]
    links = quality.document_links(spark.createDataFrame([("x/y/a.md", "[a](../../b.md) [c](./d/../e.md) [f](../nope.md)")], "path string, text string"))
    assert {r.message for r in quality.broken_links(links, spark.createDataFrame([("b.md",), ("x/y/e.md",)], "target string")).collect()} == {"../nope.md"}
    assert quality.live_links(links.withColumn("path", F.lit("b.md")), docs).count() == 0
    assert [r.path for r in quality.leftover_diagrams(spark.createDataFrame([("i", "a ```mermaid"), ("j", "b")], "id string, embed_text string")).collect()] == ["i"]


def test_search_by_cells_and_areas(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 12))
    x[600:] = x[:600] + 0.2 * rng.normal(size=(600, 12))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)] + [(5000, None)], "key long, vec array<double>")
    asked = v.where("key % 20 = 0").withColumnRenamed("key", "qid")
    exact = {(r.qid, r.key) for r in search.knn(v, asked, 5).collect()}
    found = {(r.qid, r.key) for r in search.ann(v, asked, 5, probes=12).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    assert {(r.qid, r.key) for r in search.ann(v, asked, 5, cells=4, probes=4).collect()} == exact
    near = search.neighbors(v.where("key < 50"), 3).collect()
    assert len(near) == 150 and all(r.key != r.neighbor for r in near) and {r["rank"] for r in near} == {0, 1, 2}
    hits = spark.createDataFrame([("b", 1, "x", 0.5, 0), ("a", 1, "y", 0.5, 0), ("a", 1, "z", 0.9, 1)], "area string, qid int, key string, score double, rank int")
    assert [r.key for r in search.multi_area(hits, 2).orderBy("place").collect()] == ["z", "y"]
    assert {r.commit for r in search.with_stamps(hits, spark.createDataFrame([("a", "0123456789")], "area string, commit string")).collect()} == {"01234567", None}
    lists = {"one": hits.select("qid", F.col("key").alias("path"), "rank"), "two": hits.where("key = 'x'").select("qid", F.col("key").alias("path"), "rank")}
    got = [(r.method, r.hit1) for r in search.evaluate(lists, spark.createDataFrame([(1, "x"), (2, "y")], "qid int, path string")).collect()]
    assert {m for m, _ in got} == {"one", "two"} and dict(got)["two"] == 50.0
    lines = search.grep(spark.createDataFrame([("a.md", "x İstanbul\nno\nISTANBUL")], "path string, text string"), "istanbul", "./a", limit=None)
    assert [(r.line, r.truncated) for r in search.truncated(lines, 1).collect()] == [(1, True)] and lines.count() == 2
    assert search.without_source(spark.createDataFrame([("t",), ("u",)], "path string"), "t").count() == 1


def test_embedding_and_rebuild(spark, tmp_path):
    seen = []

    def embedder(texts, kind="document"):
        return np.array([[len(t), 1.0] for t in texts]), [len(t.split()) for t in texts]

    rows = spark.createDataFrame([("a", "one two"), ("b", "three")], "k string, t string")
    assert {(r.key, r.tokens) for r in index.embed(rows, "k", "t", embedder, "query").collect()} == {("a", 2), ("b", 1)}
    asked = spark.createDataFrame([(1, "same"), (2, "same"), (3, "known")], "qid int, text string")
    known = spark.createDataFrame([(0, "known")], "qid int, text string").select(T.sha(F.col("text")).alias("key"), F.array(F.lit(9.0), F.lit(9.0)).alias("vec"))
    assert {(r.qid, tuple(r.vec)) for r in index.embed_questions(asked, embedder, known).collect()} == {(1, (4.0, 1.0)), (2, (4.0, 1.0)), (3, (9.0, 9.0))}
    cur = spark.createDataFrame([("a", "h1", "one"), ("b", "h2", "two")], "id string, hash string, embed_text string")
    docs = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, hash string")
    state = f"{tmp_path}/s"
    one = index.sync(cur, state, index.hash_embedder(8), "c1", "m1", 8, docs)
    two = index.sync(cur, state, index.hash_embedder(8), "c2", "m1", 8, docs.limit(1))
    three = index.sync(cur, state, index.hash_embedder(8), "c3", "m2", 8, docs)
    assert (one["added"], one["docs_written"]) == (2, 2) and (two["same"], two["docs_removed"]) == (2, 1) and (three["added"], three["rebuilt"], three["docs_written"]) == (2, 1, 2)
    assert not seen


def test_rows_of_logs_and_maps(spark, tmp_path):
    events = spark.createDataFrame([(1, 5, '{"query": "q", "limit": 3}', '{"count": 2, "paths": ["a", "b"]}', None)], "id int, at int, input string, result string, error string")
    r = usage.query_row(events).first()
    assert (r.asked, r.filters, r["count"], r.paths, r.failed) == ("q", "limit=3", 2, ["a", "b"], False)
    points = spark.createDataFrame([("k", 1.0, 2.0, 3.0, "backend", "L", "m")], "key string, x double, y double, z double, area string, label string, module string")
    assert layout.compact(points).first().point == ["k", "1.0", "2.0", "3.0", "backend", "L"] and layout.area_counts(points, True).first().n == 1
    hits = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "a", 2)], "qid int, path string, rank int")
    s = store.summarize(hits).first()
    assert (s["count"], s.paths) == (3, ["a", "b"])
    log = spark.createDataFrame([('{"time": "2", "level": "error", "msg": "m", "error": "e"}',), ('{"time": "3", "level": "warn", "ms',), ("plain",), ('{"time": "1", "level": "info"}',)], "value string")
    assert [r.msg for r in corpus.problems(log).collect()] == ["m"]
    root = tmp_path / "a+b c" / "kb"
    (root / "flows" / "tools").mkdir(parents=True)
    (root / "flows" / "ü 1.md").write_text("x")
    (root / "flows" / "tools" / "no.md").write_text("x")
    assert [r.path for r in corpus.corpus(spark, str(root), "kb").collect()] == ["flows/ü 1.md"]
    assert corpus.in_doc_dirs(corpus.corpus(spark, str(root), "kb")).count() == 1
    (tmp_path / "ev").mkdir()
    spark.createDataFrame([(1, "2024-01-01 10:00:30"), (1, "2024-01-01 10:02:59")], "user_id int, at string").select("user_id", F.col("at").cast("timestamp")).write.parquet(f"{tmp_path}/ev/in")
    streams.last_used_stream(spark.readStream.schema("user_id int, at timestamp").parquet(f"{tmp_path}/ev/in"), f"{tmp_path}/ev/out", f"{tmp_path}/ev/cp").awaitTermination()
    assert str(spark.read.parquet(f"{tmp_path}/ev/out").first().last_used) == "2024-01-01 10:02:00"
