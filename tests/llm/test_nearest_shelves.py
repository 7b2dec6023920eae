"""Nearest-neighbour search by shelves: what a task holds and what is shuffled do not follow the visits."""

import numpy as np
from pyspark.sql import functions as F

from stanzaflow.llm import nearest


def shuffled(plan):
    """Records written by the shuffles of a plan that has run."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(map(shuffled, below))


def brute(x, ids, queries, k=3):
    n = np.sqrt((x * x).sum(1))
    out = set()
    for q in queries:
        score = (x * x[q]).sum(1) / (n * n[q])
        out |= {(int(ids[q]), int(ids[j]), float(score[j])) for j in [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]}
    return out


def test_a_query_goes_once_to_a_shelf(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").cache()
    for shelf, shelves in ((nearest.SHELF, 1), (8 * 16 * 300, 7)):  # leaves that span several shelves too
        monkeypatch.setattr(nearest, "SHELF", shelf)
        found = nearest.search(table, table.where("vec_id % 5 = 0"), 3, leaf=20, recall=1.0)
        got = found.collect()
        want = brute(x, np.arange(2000), range(0, 2000, 5))
        assert len({(r.query_id, r.vec_id, r.score) for r in got} & want) >= 0.97 * len(want)
        # table, queries by id, queries by shelf, best of each shelf; before: a query with its vector for each of some eighty leaves
        assert shuffled(found._jdf.queryExecution().executedPlan()) <= 2000 + 400 + 400 * shelves + 400 * 3 * shelves


def test_copies_and_large_leaves(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 700, 0), rng.normal(size=(300, 8))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nearest, "SHELF", 8 * 8 * 100)  # the leaf of copies lies on seven shelves and more
    got = nearest.search(table, table.where(F.col("vec_id") % 10 == 0), 3, leaf=100_000).collect()
    assert {(r.query_id, r.vec_id, r.score) for r in got} == brute(x, np.arange(1000), range(0, 1000, 10))


def test_best_of_leaves_in_pieces(monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 7)
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (120, 3)) + 0.5  # many ties
    n = np.sqrt((x * x).sum(1))
    ids = rng.permutation(120)
    cut = [0, 3, 3, 60, 120]
    leaves = [(x[a:b], n[a:b], (x / n[:, None])[a:b], ids[a:b]) for a, b in zip(cut, cut[1:])]
    q = np.arange(0, 120, 4)
    got = nearest._met(x[q], n[q], (x / n[:, None])[q], ids[q], np.ones((len(q), 4), bool), leaves, 3)
    assert set(zip(*got.to_pydict().values())) == brute(x, ids, q)
    some = nearest._met(x[q], n[q], (x / n[:, None])[q], ids[q], np.tile([True, True, False, False], (len(q), 1)), leaves, 3)
    assert set(some.column("vec_id").to_pylist()) <= set(ids[:3].tolist())
