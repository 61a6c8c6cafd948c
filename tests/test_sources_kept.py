"""The log tail by position, and the trigram index against plain search."""

import json
import random

from loomspark.operators import grepindex, search
from loomspark.sources import tail


def test_tail_reads_from_the_end(tmp_path, monkeypatch):
    p = f"{tmp_path}/a.log"
    for block in (7, 1 << 16):
        monkeypatch.setattr(tail, "BLOCK", block)
        for text in ("", "one", "one\n", "one\ntwo", "\n\n", "a\nb\nc\nd\n", "x" * 50 + "\ny\n" + "z" * 30):
            with open(p, "w") as f:
                f.write(text)
            whole = text.split("\n")
            whole = whole[:-1] if whole[-1] == "" else whole
            for n in (1, 2, 10):
                rows = [v for s in tail.TailReader(p, n).partitions() if s.file for _, _, v in tail.lines_of(s)]
                assert rows == whole[-n:], (text, n, block)


def test_only_the_end_of_a_large_file_is_read(spark, tmp_path):
    p = f"{tmp_path}/big.log"
    with open(p, "w") as f:
        f.writelines(json.dumps({"n": i, "level": "warn"}) + "\n" for i in range(200_000))
    (part,) = tail.TailReader(p, 10).partitions()
    assert part.end - part.start < 400 and part.end > 4_000_000
    spark.dataSource.register(tail.LogTail)
    rows = spark.read.format("log_tail").option("path", p).option("lines", 10).load().collect()
    assert [json.loads(r.value)["n"] for r in rows] == list(range(199_990, 200_000)) and rows[0].at == part.start
    assert [b.end - b.start for b in tail.stretches(p, 0, 100)] == [100]


def test_a_stream_waits_for_the_end_of_a_line(spark, tmp_path):
    src, got = f"{tmp_path}/logs", []
    (tmp_path / "logs").mkdir()
    spark.dataSource.register(tail.LogTail)

    def put(name, text, mode="a"):
        with open(f"{src}/{name}", mode) as f:
            f.write(text)

    def step():
        got.clear()
        rows = spark.readStream.format("log_tail").option("path", src).option("lines", 2).load()
        q = rows.writeStream.foreachBatch(lambda df, i: got.extend(r.value for r in df.collect())).option("checkpointLocation", f"{tmp_path}/cp").start()
        q.processAllAvailable()
        q.stop()
        return sorted(got)

    put("a", "1\n2\n3\n4 is not")
    assert step() == ["2", "3"]
    # the started line ends, another begins; a new file is read whole
    put("a", " yet done\n5 beg")
    put("b", "new\n")
    assert step() == ["4 is not yet done", "new"]
    put("a", "ins\n")
    assert step() == ["5 begins"]
    # a file begun anew
    put("b", "z\n", "w")
    assert step() == ["z"]


def test_trigrams_give_the_rows_of_grep(spark, tmp_path):
    rng = random.Random(2)
    words = ["İstanbul", "ISPARTA", "kapı", "a.b*c", "ab", "x", "Straße", "", "  ", "日本語文"]
    docs = spark.createDataFrame([(f"d{i % 3}/{i}.md", "\n".join(" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(rng.randrange(1, 20)))) for i in range(40)] + [("n", None), ("e", "")], "path string, text string")
    grepindex.build(docs, f"{tmp_path}/g")
    key = lambda df: sorted(map(tuple, df.collect()))
    for needle in ("ıstan", "istan", "ISP", "a.b*c x", "ab", "x", "", "日本語", "yokki", "kapı  "):
        for prefix in ("", "./d1"):
            assert key(grepindex.grep(spark, f"{tmp_path}/g", needle, prefix, None)) == key(search.grep(docs, needle, prefix, None)), needle
    assert grepindex.grep(spark, f"{tmp_path}/g", "kap", limit=3).collect() == search.grep(docs, "kap", limit=3).collect()
    some = grepindex.candidates(spark, f"{tmp_path}/g", "a.b*c x").count()
    assert 0 < some < spark.read.parquet(f"{tmp_path}/g/lines").count() / 2
