"""Struct, function and registry facts, names through re-exports, slugs, tables in pieces, sync by stream: inline fixtures."""

import pytest
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import buckets, chunks, facts, graph, index, layout, structs
from loomspark.sources import corpus, manifest
from loomspark.streaming import rollup as streams

ATTR = """package ai
type Attr struct {
	// speed over
	// long runs
	Pace float64
	Foot, Kick float64 // both feet

	// lost

	Mind []int
}
const gainA = 0.25
func (a *Attr) Sprint(x int) float64 {
	return attrFactor(a.Pace, gainA) + attrFactor(max(a.Pace, (a.Mind + 1)), 0.5)
}
func (a *Attr) Twice() float64 {
	return a.Sprint(1) + a.Sprint(2)
}
func Use(p *Pool) { p.attr.Twice(); p.Attr.Kick; HookExecA }
func Copy(pb *Pb, a *Attr) {
	pb.foot = a.Foot
}
func Late(pb *Pb) {
	// pb.foot in a comment
	if pb.foot > 1 { return }
}
"""
MODELS = """type DetailedStats struct {
	Physical PhysicalStats `bson:"physical"`
}
type PhysicalStats struct {
	Speed int `bson:"speed"`
	Power int `bson:"power"`
	Rest  int `bson:"rest"`
}
"""
BRIDGE = """pac, sho := boost("pac"), boost("sho") + boost("dri")
x := Attr{
	Pace: eff(d.Physical.Speed, 0.5, sho),
	Kick: eff(d.Physical.Power, 0, boost("pac")),
}
if a.Kick > 0 && a.Foot > 0 {
	a.Long, a.Short = a.Kick, a.Kick
}
"""


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def lines(spark, path, text):
    return facts.source_lines(spark.createDataFrame([(path, text), ("none", None)], "path string, content string"))


def test_struct_fields(spark):
    got = rows(structs.struct_fields(lines(spark, "a.go", ATTR)), "field", "comment")
    assert got == [("Foot", "both feet"), ("Kick", "both feet"), ("Mind", ""), ("Pace", "speed over long runs")]
    assert structs.struct_fields(lines(spark, "a.go", ATTR).limit(0)).count() == 0


def test_function_facts(spark):
    own = lines(spark, "a.go", ATTR)
    bodies, fields = structs.function_bodies(own), structs.struct_fields(own)
    assert rows(bodies, "func", "line") == [("Attr.Sprint", 13), ("Attr.Twice", 16), ("Copy", 20), ("Late", 23), ("Use", 19)]
    reads, calls = structs.reads(bodies, fields), structs.calls(bodies)
    assert rows(reads, "func", "field") == [("Attr.Sprint", "Mind"), ("Attr.Sprint", "Pace"), ("Late", "Foot"), ("Use", "Kick")]
    assert rows(calls, "func", "callee") == [("Attr.Twice", "Attr.Sprint"), ("Use", "Attr.Twice")]
    assert rows(structs.gains(bodies, facts.constants(own)), "func", "arg", "expr", "value") == [("Attr.Sprint", "a.Pace", "gainA", 0.25), ("Attr.Sprint", "max(a.Pace, (a.Mind + 1))", "0.5", 0.5)]
    assert rows(structs.hooks_of(bodies), "func", "hook") == [("Use", "HookExecA")]
    users = graph.users_of(reads, calls, spark.createDataFrame([], "func string"))
    got = {(r.field, r.func): r.via for r in users.collect()}
    assert got[("Pace", "Use")] == ["Attr.Twice"] and got[("Pace", "Attr.Sprint")] == [] and got[("Pace", "Attr.Twice")] == ["Attr.Sprint"]
    pool = graph.users_of(reads, calls, spark.createDataFrame([("Attr.Sprint",)], "func string"))
    assert {r.field for r in pool.collect()} == {"Foot", "Kick"}
    stats = spark.createDataFrame([("s.speed", "Pace"), ("s.old", "Gone"), ("s.none", None), ("s.copied", "Src")], "path string, field string")
    aliases = spark.createDataFrame([("Src", ["Kick"])], "field string, targets array<string>")
    assert rows(structs.metric_map(stats, users, aliases), "path", "used") == [("s.copied", True), ("s.none", False), ("s.old", False), ("s.speed", True)]


def test_bridge_and_copies(spark):
    files = spark.createDataFrame([("b.go", BRIDGE), ("n", None)], "path string, content string")
    got = rows(structs.stat_bridge(lines(spark, "m.go", MODELS), files).na.fill("").na.fill(-1.0), "path", "field", "face", "share")
    assert got == [("physical.power", "Kick", "", -1.0), ("physical.rest", "", "", -1.0), ("physical.speed", "Pace", "sho + dri", 0.5)]
    assert rows(structs.alias_copies(facts.source_lines(files)), "field", "targets", "condition") == [("Kick", ["Long", "Short"], "a.Kick > 0")]


def test_styles(spark):
    own = lines(spark, "s.go", 'const styleTend = 1.2\n\tHookTendRun // runs more\n\tHookExecShot\n\t"Poacher": {{hook: HookTendRun, tend: true}, {hook: HookExecShot, inv: true}}, // near goal\n')
    assert rows(structs.style_hooks(own), "hook", "kind", "comment") == [("HookExecShot", "exec", ""), ("HookTendRun", "tend", "runs more")]
    s = structs.styles(own).first()
    assert (s.style, s.note, [tuple(e) for e in s.effects]) == ("Poacher", "near goal", [("HookTendRun", True, False), ("HookExecShot", False, True)])
    k = spark.range(1).select(*(T.style_multiplier(F.lit(t), F.lit(i), F.lit(1.25), F.lit(z)).alias(n) for n, t, i, z in (("a", True, False, 2.0), ("b", False, True, 2.0), ("c", False, True, 0.0)))).first()
    assert tuple(k) == (1.25, 0.5, None)


def test_names_through_reexports(spark):
    imports = spark.createDataFrame([("app", "barrel", "x"), ("x1", "deep", "d")], "src string, dst string, name string")
    reexports = spark.createDataFrame([("barrel", 0, "x", "x1", "inner"), ("barrel", 1, "y", "y1", "y"), ("barrel", 2, "*", "z1", "*"), ("z1", 0, "*", "barrel", "*")], "file string, nth int, name string, target string, source string")
    exports = spark.createDataFrame([("x1", "inner"), ("y1", "y"), ("z1", "z"), ("deep", "d")], "file string, name string")
    seeds = spark.createDataFrame([("app",)], "node string")
    assert rows(graph.reachable_by_name(imports, reexports, exports, seeds), "node") == [("app",), ("barrel",), ("deep",), ("x1",)]
    everything = spark.createDataFrame([("app", "barrel", "*")], "src string, dst string, name string")
    assert rows(graph.reachable_by_name(everything, reexports, exports, seeds), "node") == [("app",), ("barrel",), ("x1",), ("y1",), ("z1",)]
    wanted = spark.createDataFrame([("barrel", "x"), ("barrel", "z"), ("barrel", "none")], "file string, name string")
    assert rows(graph.origin(reexports, exports, wanted), "file", "name", "at_file", "at_name") == [("barrel", "x", "x1", "inner"), ("barrel", "z", "z1", "z")]
    two = spark.createDataFrame([("f", 0, "*", "p", "*"), ("f", 1, "n", "q", "n"), ("p", 0, "*", "r", "*")], "file string, nth int, name string, target string, source string")
    defs = spark.createDataFrame([("q", "n"), ("r", "n")], "file string, name string")
    assert rows(graph.origin(two, defs, spark.createDataFrame([("f", "n")], "file string, name string")), "at_file") == [("r",)]


@pytest.mark.parametrize("file, path, slug", [("app/(tabs)/index.tsx", "/", "tabs-index"), ("app/buildings/[id].tsx", "/buildings/[id]", "buildings-id"), ("app/_layout.tsx", "kök düzen", "kok-duzen"), ("app/(tabs)/_layout.tsx", "(tabs) düzeni", "tabs-_layout"), ("app/myHTTPPage.tsx", "/myHTTPPage", "my-http-page")])
def test_routes(spark, file, path, slug):
    assert tuple(spark.range(1).select(T.route_path(F.lit(file)), T.route_slug(F.lit(file))).first()) == (path, slug)


def test_tables_in_pieces(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| row{i:02d} | x |" for i in range(20))
    docs = spark.createDataFrame([("p", "T", f"before\n\n{table}\n\nafter"), ("q", "T", None), ("r", "T", "short")], "path string, title string, text string")
    got = sorted((r.path, r.part, r.text) for r in chunks.chunks(docs, 100).collect())
    mine = [t for p, _, t in got if p == "p"]
    assert mine[0] == "before" and mine[-1] == "after" and all(len(t) <= 102 and t.startswith("| a | b |\n|---|---|\n| row") for t in mine[1:-1])
    assert [x for t in mine[1:-1] for x in t.split("\n")[2:]] == table.split("\n")[2:]
    assert [t for p, _, t in got if p == "r"] == ["short"]


def test_front_fields_and_ground_truth(spark):
    head = "title: \"A: b\"\naliases: [x, 'y z']\nsources:\n  - a/b.ts\n  - c.ts\nempty:\ntitle: last"
    got = spark.createDataFrame([(head,), (None,)], "h string").select(T.front_fields(F.col("h")).alias("m")).collect()
    assert got[0].m == {"title": ["last"], "aliases": ["x", "y z"], "sources": ["a/b.ts", "c.ts"], "empty": []} and got[1].m == {}
    md = "## Other\n| q | [n](n.md) |\n## Which\n| Soru | D |\n|---|---|\n| how | [a](../flows/x.md#t), [b](./y.md) |\n| none | text |\n## End\n| z | [n](n.md) |"
    docs = spark.createDataFrame([("g", md), ("h", None)], "path string, body string")
    assert rows(corpus.ground_truth(docs, "Which"), "path", "text", "docs") == [("g", "how", ["flows/x.md", "genel/y.md"])]


def test_map_by_stamp(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), float(i * i), 1.0]) for i in range(6)], "key long, vec array<double>")
    first = layout.update(v, f"{tmp_path}/map", "a@1")
    assert first.count() == 6 and layout.update(v.limit(1), f"{tmp_path}/map", "a@1").count() == 6
    assert layout.update(v.limit(1), f"{tmp_path}/map", "a@2").count() == 1
    assert len(layout.compact(first).first().point) == 4


def test_corpus_sync_and_read_hits(spark, tmp_path):
    def put(n, ids):
        spark.createDataFrame([(i, f"text {i}") for i in ids], "id string, embed_text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")

    def whole():
        return spark.read.parquet(f"{tmp_path}/docs").select("id", T.sha(F.col("embed_text")).alias("hash"), "embed_text")

    def sync():
        docs = spark.readStream.schema("id string, embed_text string").parquet(f"{tmp_path}/docs")
        streams.corpus_sync(docs, whole, f"{tmp_path}/state", f"{tmp_path}/cp", index.hash_embedder(8)).awaitTermination()
        return manifest.read(spark, f"{tmp_path}/state")[0]

    put(0, ["a", "b"])
    assert sync() == 1 and sync() == 1
    put(1, ["c"])
    assert sync() == 2 and buckets.table(spark, f"{tmp_path}/state", "store").count() == 3

    points = spark.createDataFrame([(1, "backend", "a.md"), (2, "frontend", "a.md"), (3, "backend", "a.md")], "key long, area string, path string")
    events = spark.createDataFrame([(1, 0, "read_doc", "./a"), (2, 0, "read_doc", "frontend/a.md"), (3, 0, "search", "a"), (4, 0, "read_doc", None), (5, 0, "read_doc", " ")], "id long, at long, tool string, text string")
    assert rows(streams.read_hits(events, points), "id", "key") == [(1, 1), (1, 3), (2, 2)]
