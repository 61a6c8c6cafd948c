"""Walks read their edges once."""

from loomspark.operators import graph


def test_a_walk_computes_its_edges_once(spark):
    """Edges that a step computes were computed, and shuffled, in every round."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    chain = spark.range(12).selectExpr("id as src", "id + 1 as dst").union(spark.createDataFrame([(None, 3), (2, None), (3, 3), (3, 4)], "src long, dst long"))
    edges = chain.repartition(2).mapInArrow(count, "src long, dst long")
    root, stops = spark.range(1).selectExpr("id as node"), spark.range(9, 10).selectExpr("id as node")
    assert sorted(r.node for r in graph.closure(edges, root, stops).collect()) == list(range(9))
    assert seen.value == 16
