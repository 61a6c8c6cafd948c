"""op10 on rows that stand more than once."""

import random

import pytest
from loomspark.llm import suffixes


@pytest.mark.parametrize("partitions", [1, 3])
def test_repeated_rows_are_not_copies_of_themselves(spark, partitions):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    base = " ".join(word() for _ in range(200))
    rows = [(3, base), (3, base), (1, " ".join(word() for _ in range(90))), (5, base[:400] + "~" + base[400:]), (5, base[:400] + "~" + base[400:]), (7, base + " end"), (3, base), (8, None), (8, None), (9, base[200:450])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    seen, want = set(), {}
    for i, t in sorted(dict(rows).items()):
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = [True] * 100
            seen.add(b[p : p + 100])
        want[i] = bytes(x for x, g in zip(b, gone) if not g)
    got = suffixes.suffix_dedup(docs, keep_bytes=True).collect()
    assert len(got) == len(rows)
    assert all(bytes(r.kept) == want[r.doc_id] and r.n_removed == len((dict(rows)[r.doc_id] or "").encode()) - len(want[r.doc_id]) for r in got)
    assert [r.n_removed for r in got if r.doc_id == 3] == [0, 0, 0]
