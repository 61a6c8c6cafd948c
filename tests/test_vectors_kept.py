"""Approximate vectors: recall against exact search, maps by the graph, lookups by level."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import layout, lists, nngraph, search
from loomspark.operators.policy import Policy, QueryRefused, TablePolicy


def vectors(spark, n, d=16, clusters=20, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, d))[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)) * 0.4
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "key long, vec array<double>")


def share(got, true):
    return sum(len(got.get(q, set()) & t) for q, t in true.items()) / sum(map(len, true.values()))


def by_key(df, key, other):
    found = {}
    for r in df.collect():
        found.setdefault(r[key], set()).add(r[other])
    return found


def test_descent_finds_the_neighbours(spark):
    v = vectors(spark, 1200)
    # copies, a zero vector and one that is null
    more = spark.createDataFrame([(10_000 + i, [1.0] * 16) for i in range(40)] + [(20_000, [0.0] * 16), (20_001, None)], "key long, vec array<double>")
    v = v.unionByName(more)
    graph = nngraph.descend(v, 10)
    rows = graph.collect()
    assert all(r.key != r.neighbor for r in rows) and {r.key for r in rows} == {r.key for r in v.collect()} - {20_001}
    assert all(sorted(x.rank for x in rows if x.key == k) == list(range(10)) for k in (0, 17, 10_003))
    asked = v.where("key % 9 = 0 and key < 9000").select(F.col("key").alias("qid"), "vec")
    true = by_key(search.neighbors(v, 10).where("key % 9 = 0 and key < 9000"), "key", "neighbor")
    assert asked.count() == len(true) and share(by_key(graph, "key", "neighbor"), true) >= 0.95
    # scores are cosines
    exact = {(r.key, r.neighbor): r.score for r in search.neighbors(v, 10).collect()}
    assert all(abs(r.score - exact[r.key, r.neighbor]) < 1e-5 for r in rows if (r.key, r.neighbor) in exact)


def test_descent_pairs_no_whole_tables(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(nngraph, "written", lambda df, real=nngraph.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    nngraph.descend(vectors(spark, 300), 5).collect()
    assert plans and not any("CartesianProduct" in p or "NestedLoop" in p for p in plans)


def test_small_graphs(spark):
    assert nngraph.descend(vectors(spark, 1)).collect() == []
    assert nngraph.descend(vectors(spark, 1).limit(0)).collect() == []
    assert by_key(nngraph.descend(vectors(spark, 3), 5), "key", "neighbor") == {0: {1, 2}, 1: {0, 2}, 2: {0, 1}}


def test_lists_reach_their_recall(spark, tmp_path):
    v = vectors(spark, 2000)
    lists.build(v, f"{tmp_path}/ix")
    probes = lists.tune(v, f"{tmp_path}/ix", 10)
    asked = v.where("key % 20 = 0").select(F.col("key").alias("qid"), "vec")
    told = lists.recall(v, asked, f"{tmp_path}/ix", 10).first()
    assert told.recall >= 0.95 and told.probes == probes < told.lists and (told.vectors, told.queries) == (2000, 100)
    # every vector is in one list
    assert spark.read.parquet(f"{tmp_path}/ix/lists").agg(F.count("*"), F.countDistinct("key")).first() == (2000, 2000)
    # with all lists and enough candidates it is the exact search
    whole = lists.search_lists(v, asked, f"{tmp_path}/ix", 5, probes=told.lists, again=40)
    key = lambda df: sorted(map(tuple, df.select("qid", "key", "score", "rank").collect()))
    assert key(whole) == key(search.knn(v, asked, 5))


def test_lists_of_an_empty_table_and_of_copies(spark, tmp_path):
    none = vectors(spark, 3).limit(0)
    lists.build(none, f"{tmp_path}/none")
    assert lists.tune(none, f"{tmp_path}/none") == 1
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(500)] + [(500, None)], "key long, vec array<double>")
    lists.build(same, f"{tmp_path}/same")
    asked = same.where("key = 3").select(F.col("key").alias("qid"), "vec")
    assert {r.score for r in lists.search_lists(same, asked, f"{tmp_path}/same", 4, probes=1).collect()} == {1.0}


def test_spectral_map_keeps_groups_together(spark):
    # four rings, joined by one edge each
    edges = [(10 * g + i, 10 * g + (i + 1) % 10) for g in range(4) for i in range(10)] + [(10 * g, 10 * ((g + 1) % 4) + 5) for g in range(4)]
    graph = spark.createDataFrame(edges, "key long, neighbor long")
    points = {r.key: np.array([r.x, r.y, r.z]) for r in layout.spectral3d(graph, 24).collect()}
    again = {r.key: np.array([r.x, r.y, r.z]) for r in layout.spectral3d(graph.repartition(3), 24).collect()}
    assert set(points) == set(range(40)) and all(np.abs(points[k] - again[k]).max() < 2e-3 for k in points)
    assert max(np.linalg.norm(p) for p in points.values()) <= 1.001
    apart = lambda pairs: np.mean([np.linalg.norm(points[a] - points[b]) for a, b in pairs])
    inside = [(a, b) for a in points for b in points if a < b and a // 10 == b // 10]
    across = [(a, b) for a in points for b in points if a < b and a // 10 != b // 10]
    assert apart(edges) < apart(inside) < apart(across) / 2
    assert [r.x for r in layout.spectral3d(graph.where("key = 1")).collect()] == [0.0] * 2


def test_graph_lookup_by_levels(spark):
    p = Policy({"n": TablePolicy("n", joinable=True), "users": TablePolicy("u", joinable=False)}, denied="token", key="id")
    nodes = [(1, [2, 3], "a"), (2, [4], "b"), (3, [4, 1], "c"), (4, [None, 5], "d"), (5, [1], "e"), (6, None, "f")]
    right = spark.createDataFrame([(*n, "t") for n in nodes], "id long, next array<long>, name string, token string")
    left = spark.createDataFrame([(10, 1), (11, 5), (12, None), (13, 1), (14, 77)], "who long, first long")
    look = lambda **how: {(r.who, r.found.id, r.depth) for r in p.graph_lookup(left, right, "n", "first", "next", "id", "id", **how).collect()}
    reach = {1: {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3)}, 5: {(5, 0), (1, 1), (2, 2), (3, 2), (4, 3)}}
    assert look() == {(w, i, d) for w, s in ((10, 1), (13, 1), (11, 5)) for i, d in reach[s]}
    assert look(max_depth=1) == {(w, i, d) for w, s in ((10, 1), (13, 1), (11, 5)) for i, d in reach[s] if d <= 1}
    # a row that isn't kept isn't passed through
    assert {(i, d) for w, i, d in look(where=F.col("name") != "d") if w == 10} == {(1, 0), (2, 1), (3, 1)}
    assert "token" not in p.graph_lookup(left, right, "n", "first", "next", "id", "id").schema["found"].dataType.names
    for bad in (lambda: p.graph_lookup(left, right, "users", "first", "next", "id", "id"), lambda: p.graph_lookup(left, right, "unknown", "first", "next", "id", "id"), lambda: p.graph_lookup(left, right, "n", "first", "token", "id", "id"), lambda: look(where=F.col("token") == "t")):
        with pytest.raises(QueryRefused):
            bad()
