"""The verdict of the flattened trees against a plain walk from node to node."""

import math
import random

import numpy as np

from loomspark.llm import quality


def walk(trees, x):
    """The margin of one document."""
    total = trees.base
    for at in trees.start:
        while trees.feature[at] >= 0:
            at = trees.left[at] if x[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
        total += trees.value[at]
    return total


def texts(n):
    rng = random.Random(11)
    good, junk = [f"word{i}" for i in range(300)], ["####", "$$$", "a", "||", "buy"]
    made = []
    for i in range(n):
        bad = i % 3 == 0
        made.append("\n".join(" ".join(rng.choices(junk if bad and rng.random() < 0.8 else good, k=rng.randrange(1, 25))) for _ in range(rng.randrange(1, 14))))
    return made


def test_verdict_is_that_of_a_plain_walk(spark):
    docs = [(i, t) for i, t in enumerate(texts(400))] + [(1000, None), (1001, ""), (1002, "x " * 3000)]
    labels = [(i, int(i % 3 != 0), 0) for i in range(0, 400, 2)] + [(4, None, 0), (None, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trees = quality.fit(d, lab)
    got = {r.doc_id: r for r in quality.score(d, trees).collect()}
    verdicts = set()
    for i, text in docs:
        numbers, features = quality.counts(text)
        failed = numbers[0] < 50 or 100 * numbers[4] > 50 * numbers[0]
        p = 1 / (1 + math.exp(-walk(trees, features)))
        assert math.isclose(got[i].quality_score, p, rel_tol=1e-9)
        assert (got[i].base_failed, got[i].kept) == (failed, not failed and p >= 0.5)
        verdicts.add((failed, got[i].kept))
    assert len(verdicts) == 3


def test_ties_with_a_threshold_go_left():
    trees = quality.Trees(*(np.array(v) for v in ([0, -1, -1], [2.5, 0.0, 0.0], [1, 0, 0], [2, 0, 0], [0.0, -1.0, 1.0])), np.array([0]), 0.25)
    x = np.array([[2.5], [2.4], [2.6]])
    assert trees.margin(x).tolist() == [walk(trees, r) for r in x] == [-0.75, -0.75, 1.25]
