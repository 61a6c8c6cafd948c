"""Lists of a trigram index against plain sets."""

import pyarrow as pa

from loomspark.operators import grepindex

LINES = ["aaaa", "", "ab", "xabc", "\U0001f600bc\U0001f600bc", "bca", "ğüşğüş", "abc abc"]


def test_one_list_for_each_trigram_of_a_batch():
    """A row for each trigram of a line was what an index shuffled twice."""
    batch = pa.RecordBatch.from_arrays([pa.array([7 + 3 * i for i in range(len(LINES))]), pa.array(LINES)], names=["n", "folded"])
    got = {}
    for b in grepindex._lists(iter([batch, batch.slice(0, 0)])):
        for r in b.to_pylist():
            assert r["gram"] not in got
            got["".join(chr(r["gram"] >> s & 0x1FFFFF) for s in (42, 21, 0))] = r["ns"]
    want = {}
    for i, line in enumerate(LINES):
        for g in {line[j : j + 3] for j in range(len(line) - 2)}:
            want.setdefault(g, []).append(7 + 3 * i)
    assert got == want


def test_an_index_holds_each_line_once_for_a_trigram(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{i % 5}/{i}", "\n".join(LINES)) for i in range(40)], "path string, text string")
    grepindex.build(rows, f"{tmp_path}/g")
    held = spark.read.parquet(f"{tmp_path}/g/grams")
    assert set(held.columns) == {"gram", "ns", "bucket"}
    assert held.selectExpr("gram", "explode(ns) as n").groupBy("gram", "n").count().where("count > 1").count() == 0
    assert grepindex.candidates(spark, f"{tmp_path}/g", "ABC").count() == 80
