"""The neighbour graph goes on until its lists hold the true neighbours of a sample."""

import numpy as np

from loomspark.operators import nngraph


def test_rounds_go_on_until_the_lists_are_good(spark):
    x = np.random.default_rng(3).normal(size=(1500, 24))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "key long, vec array<double>")
    # one tree and a bound that any round's changes are below: by changes alone it would end at once
    graph = nngraph.descend(v, 10, trees=1, joined=4, least_change=1.0).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    true = {(i, int(j)) for i, row in enumerate(np.argsort(-score, axis=1)[:, :10]) for j in row}
    found = {(r.key, r.neighbor) for r in graph}
    assert len(graph) == len(found) == 15000 and len(found & true) >= 0.9 * len(true)
