"""What of the training texts reaches the driver."""

import pytest

pytest.importorskip("stanzaflow.llm")

from stanzaflow.llm import language_id  # noqa: E402


def test_sample_is_bounded_in_bytes(spark):
    rows = [(i, ("abc déf " * 50_000 if i % 3 else f"short {i}"), "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.training_sample(docs, 10, draws=400)
    assert {lang for _, lang in got} == {"en", "fr"} and len(got) <= 20
    texts = {t.encode() for _, t, _ in rows}
    assert all(b in texts or len(b) == 20 * language_id.WINDOW for b, _ in got)
    for b, _ in got:
        windows = [b[k : k + language_id.WINDOW] for k in range(0, len(b), language_id.WINDOW)]
        assert any(all(w.rstrip(b"\0") in t for w in windows) for t in texts)
    assert len({b for b, _ in got}) > 4  # places differ from document to document
    assert sorted(got) == sorted(language_id.training_sample(docs.repartition(7), 10, draws=400))
    assert language_id.training_sample(docs.where("false")) == []


def test_all_windows_where_there_are_few(spark):
    docs = spark.createDataFrame([(i, f"only one text {i} " * 9, "en") for i in range(20)], "doc_id long, text string, lang string")
    for b, _ in language_id.training_sample(docs, 5, draws=10**6):
        assert b.decode() in {f"only one text {i} " * 9 for i in range(20)}
