"""Signs of near-dedup's nodes; calibration of the nearest-neighbour search where vec_ids repeat."""

import numpy as np
from pyspark.sql import functions as F

from stanzaflow.llm import near_dedup, nearest


def test_signs(spark):
    """Equal sets have one 128-bit sign, others their own, and every node its least id."""
    rows = [(5, "a b c d"), (3, "A b C d"), (9, "a b c e"), (2, ""), (4, None), (None, "a b c d"), (7, "a b c e"), (7, "x y z")]
    found, of = near_dedup.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    signs = {(r.doc_id, r.n_shingles, bytes(r.sign) if r.sign else None) for r in found.collect()}
    assert {len(s) for *_, s in signs if s} == {16} and {d for d, _, s in signs if s is None} == {2, 4}
    assert len({s for *_, s in signs if s}) == 3 == of.count()
    assert sorted(r["first"] for r in of.collect()) == [3, 7, 7]


def test_rows_without_words_are_not_joined(spark):
    """Many of them: each is its own component, and none meets the others in a task of a join."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("some words here "), (F.col("id") % 3).cast("string"))).otherwise("").alias("text"))
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.components(docs).collect()}
    least = {}
    for i in range(0, 500, 5):
        least.setdefault(i % 3, i)
    assert got == {i: (i, True) if i % 5 else (least[i % 3], least[i % 3] == i) for i in range(500)}


def test_best_tells_the_row():
    """Two rows of one id, far apart: each pair carries the row it came from."""
    x = np.array([[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]])
    one, q = np.ones(3), np.array([[1.0, 0.0], [0.0, 1.0]])
    got = nearest._best(q, np.ones(2), q, np.array([90, 91]), x, one, x, np.array([7, 7, 8]), 1)
    assert got == [(90, 7, 1.0, 0), (91, 7, 1.0, 1)]


def test_repeated_ids(spark):
    """Ids that repeat in different places: recall of (query, score) against all rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8)) + 4 * rng.integers(0, 2, size=(1500, 1))
    ids = np.arange(1500) % 500
    t = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = nearest.search(t, t.where("vec_id % 50 = 0"), 5, leaf=40).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in range(0, 500, 50):
        at = min((x[j].tolist(), j) for j in np.flatnonzero(ids == q))[1]
        near = u @ u[at]
        best = np.sort(near[ids != q])[-5:]
        hit += sum(r.score >= best[0] - 1e-9 for r in got if r.query_id == q)
    assert len(got) == 50 and hit >= 45
