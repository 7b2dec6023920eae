import os

import pytest

pytest.importorskip("stanzaflow.llm")


def test_no_stage_stays(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, _: d.where("doc_id % 2 = 0")), ("two", lambda s, d, _: d.where("doc_id % 3 = 0")), ("three", lambda s, d, _: d.select("doc_id"))])
    folder = spark.conf.get("spark.checkpoint.dir")
    left = lambda: sorted(x.split("-")[1] for x in os.listdir(folder) if x.startswith("stage-"))
    before = left()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(r[0] for r in rows.collect()) == list(range(0, 200, 6)) and left() == sorted([*before, "two"])
    corpus_pipeline.write(spark, "/root/testdata/sf0.001", str(tmp_path / "out"))
    assert left() == sorted([*before, "two"]) and spark.read.parquet(str(tmp_path / "out")).count() == 34
