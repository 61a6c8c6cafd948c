"""What a worker keeps between stages, and how many rows it holds at once."""

from loomspark.llm import common


def test_old_memories_are_handed_back_once_a_stage(monkeypatch):
    stage, told = [1], []
    monkeypatch.setattr(common, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"stageId": lambda self: stage[0]})())}))
    monkeypatch.setattr(common, "RELEASED", [lambda: told.append("released")])
    monkeypatch.setattr(common, "_last_stage", [None])
    monkeypatch.setattr(common, "trim", lambda: told.append("trimmed"))
    common.release_old()
    common.release_old()
    stage[0] = 2
    common.release_old()
    assert told == ["released", "trimmed"] * 2


def test_a_batch_goes_to_python_in_parts(spark):
    docs = spark.range(0, 7000, 1, 1).withColumnRenamed("id", "doc_id")
    got = common.map_columns(docs, ["doc_id"], ["doc_id"], {"held": "long", "same": "long"}, lambda ids: [[len(ids)] * len(ids), ids]).collect()
    assert sorted(r.doc_id for r in got) == list(range(7000)) and all(r.doc_id == r.same for r in got)
    assert max(r.held for r in got) <= 2000
