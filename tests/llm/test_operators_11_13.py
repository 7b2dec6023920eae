"""Periodic runs, decontamination and clustering against brute force; their SQL is compared in test_llm."""

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("stanzaflow.llm")
from pyspark.sql import functions as F  # noqa: E402

from oracle import connect, same  # noqa: E402

from stanzaflow.llm import clustering, decontamination, periodic_runs, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
NORMAL = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_runs(w):
    """Every stretch of words equal to those q on, extended as far as it goes; of periods over one stretch the least."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i - s + q), q)
            i += i == s
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k, n = rng.choice([1, 2, 2, 3, 5]), rng.choice([0, 1, 2, 5, 10, 30, 60])
            w = [rng.randrange(k) for _ in range(n)]
            if rng.random() < 0.4 and n > 4:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        assert periodic_runs.runs_of(texts) == [brute_runs(w) for w in texts]


def test_runs_by_hand():
    a, b = list("abcab" * 3), ["x"] * 5_000 + ["y"]
    fibonacci, word = ["a"], ["a", "b"]
    while len(word) < 200:
        fibonacci, word = word, word + fibonacci
    assert periodic_runs.runs_of([a, [], b, word]) == [brute_runs(a), [], [(0, 5_000, 1)], brute_runs(word)]
    assert periodic_runs.kept(8, [(0, 5, 2), (3, 5, 2)]) == [True, True, False, False, False, False, False, False]


def test_refinement_looks_at_smaller_parts(monkeypatch):
    """The positions that leave their classes stay under n log n where every class splits again and again."""
    moved, leave = [0], periodic_runs.Classes.leave
    monkeypatch.setattr(periodic_runs.Classes, "leave", lambda self, at, *rest: (moved.__setitem__(0, moved[0] + len(at)), leave(self, at, *rest))[1])
    n = 2_000
    periodic_runs.runs_of([["a"] * n + ["b"] + ["a"] * (n // 2)])
    assert moved[0] < 3 * n * np.log2(n) / 4


def test_runs_of_documents(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 10), (4, "a b " * 10), (None, "x " * 11), (5, "x y " * 12), (6, " ".join(f"w{i}" for i in range(40_000)) + " z z" * 9)]
    docs = spark.createDataFrame([(i, t, 7, "s") for i, t in rows], "doc_id long, text string, runs int, collapsed string")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.find(docs).collect()), key=str)
    long = " ".join(f"w{i}" for i in range(40_000)) + " z"
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 20, 2)], "a b"), (4, [(0, 20, 2)], "a b"), (None, [], " ".join("x" * 11)), (5, [(0, 12, 1)], "x y"), (6, [(40_000, 18, 1)], long)]
    assert got == sorted(want, key=str)
    assert periodic_runs.find(docs.where("false")).count() == 0
    empty = periodic_runs.digest(periodic_runs.find(docs.where("doc_id = 1"))).first()
    assert (empty.n_runs, empty.start, empty.exponent_milli) == (0, None, None) and empty.runs_sha256 == empty.collapsed_sha256 == hashlib.sha256(b"").hexdigest()


def brute_matches(text, items, window=10):
    w = NORMAL.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, held = set(), set()
    for name, t in items:
        x = NORMAL.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n = min(window, len(x))
        tests = {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in tests:
                hit |= set(range(i, i + n))
                held |= {str(name)} - {"None"}
    return len(w), len(hit), sorted(held)


ITEMS = [(1, " ".join(f"q{i}" for i in range(14))), (2, "Two, words"), (2, "Two, words"), (10, None), (11, "...!"), (None, "nameless but long enough to be a window of its own for sure yes"), (3, " ".join(f"q{i}" for i in range(4, 14))), (4, "é 日本 Ünder")]
TEXTS = [None, "", "...", "two words", "TWO-WORDS? two two words", "x " * 30_000 + " ".join(f"Q{i}" for i in range(13)) + " x" * 30_000, "q3 " + " ".join(f"q{i}" for i in range(4, 14)) + " q14", "Nameless but long enough to be a window of its own for sure", "two", "a É 日本 Ünder", "a é 日本, Ünder", "clean text here"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*x, "extra") for x in ITEMS], "item_id long, text string, doc string")


@pytest.mark.parametrize("limit", [decontamination.BROADCAST_BYTES, 0])
def test_windows_against_brute_force(spark, items, limit):
    docs = spark.createDataFrame([(k // 2 if k else None, t, k) for k, t in enumerate(TEXTS)], "doc_id long, text string, items int")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontamination.report(docs, items, broadcast_bytes=limit).collect()), key=str)
    want = [(k // 2 if k else None, *brute_matches(t, ITEMS), brute_matches(t, ITEMS)[1] > 0) for k, t in enumerate(TEXTS)]
    assert got == sorted(want, key=str)
    assert decontamination.report(docs.where("false"), items, broadcast_bytes=limit).count() == 0
    assert not any(r.contaminated for r in decontamination.report(docs, items.where("false"), broadcast_bytes=limit).collect())


def test_both_ways_agree(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda df: sorted(map(str, df.collect()))
    assert key(decontamination.report(docs, items)) == key(decontamination.report(docs, items, broadcast_bytes=0))


def test_hits_removed(spark, items):
    docs = spark.createDataFrame([(1, "Before. Two words! After", 5), (2, None, 6), (2, "clean", 7)], "doc_id long, text string, spans int")
    assert sorted((r.doc_id, r.spans) for r in decontamination.decontaminated(docs, items).collect()) == [(2, 6), (2, 7)]
    for limit in (decontamination.BROADCAST_BYTES, 0):
        cut = decontamination.decontaminated(docs, items, whole=False, broadcast_bytes=limit)
        assert cut.columns == docs.columns and sorted(map(tuple, cut.collect()), key=str) == [(1, "Before. ! After", 5), (2, "clean", 7), (2, None, 6)]


def test_index_bounds_are_checked(spark, items, monkeypatch):
    """Items beyond the bound are never collected."""
    monkeypatch.setattr(decontamination, "Index", None)
    docs = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    assert decontamination.report(docs, items, broadcast_bytes=100).first().n_hit == 2


def brute_clusters(rows, k, rounds):
    """rows: (vec_id, list of integers)."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [list(r[1]) for r in order[:k]]
    near = lambda v: min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(v, c[j])), j))
    for _ in range(rounds):
        own = [near(v) for _, v in rows]
        for j in range(len(c)):
            if mine := [v for (_, v), o in zip(rows, own) if o == j]:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, near(v)) for i, v in rows]
    return sorted(((i, j, sum((a - b) ** 2 for a, b in zip(v, c[j])), tuple(c[j])) for (i, j), (_, v) in zip(out, rows)), key=str)


@pytest.mark.parametrize("near,k,n,spread", [(1, 8, 300, 3), (4, 8, 300, 3), (7, 8, 200, 1), (2, 5, 3, 9), (3, 1, 20, 5), (3, 30, 400, 6)])
def test_clusters_against_full_scans(spark, near, k, n, spread):
    """Small grids: ties everywhere, copies of vectors and of ids."""
    rng = random.Random(near * k)
    rows = [(rng.choice([None, *range(n)]), [rng.randint(-spread, spread) + 40 * rng.randrange(2) for _ in range(3)]) for _ in range(n)]
    got = clustering.cluster(spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3), k, 6, near=near)
    assert sorted(((r.vec_id, r.cluster, r.distance, tuple(r.centroid)) for r in got.collect()), key=str) == brute_clusters(rows, k, 6)
    sums = got.groupBy("cluster").agg(F.sum("distance").alias("d"), F.max("cluster_inertia").alias("i"), F.max("inertia").alias("whole")).collect()
    assert all(r.d == r.i for r in sums) and {r.whole for r in sums} == {sum(r.d for r in sums)}


def test_bounds_spare_scans(spark):
    """On the given vectors later rounds certify most rows without a full scan, and the number of bounds adapts."""
    rows = clustering.whole_numbers(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    c = clustering.first_centroids(rows)
    x = np.array([r.v for r in rows.select("v").collect()], np.int64)
    state, shares = clustering.Bounds.unknown(len(x), 4), []
    for _ in range(10):
        used = state.assign(x, c)
        shares.append(float((used > 4).mean()))
        fresh = np.array([x[state.own == j].sum(0) // max(1, (state.own == j).sum()) if (state.own == j).any() else c[j] for j in range(len(c))])
        assert (state.own == ((x[:, None] - c) ** 2).sum(2).argmin(1)).all()
        state.moved(clustering._over(clustering._squared(fresh, c)))
        c = fresh
    assert shares[0] == 1 and np.mean(shares[4:]) < 0.5
    wide = clustering.Bounds(*state.__dict__.values()).narrowed(2)
    assert wide.near.shape[1] == 2 and (wide.low[:, 2] <= state.low[:, 2:].min(1)).all()


def test_vectors_that_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5] * 64), (2, None), (3, []), (4, [1.0] * 63), (5, [nan] + [1.0] * 63), (6, [inf] + [1.0] * 63), (7, [None] + [1.0] * 63), (None, [-0.3] * 64), (8, [0.0] * 64), (8, [0.0] * 64)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string")
    got = clustering.cluster(clustering.whole_numbers(table))
    assert sorted(((r.vec_id, r.distance) for r in got.collect()), key=str) == [(1, 0), (8, 0), (8, 0), (None, 0)]
    assert clustering.whole_numbers(table).where("vec_id is null").first().v[0] == -308
    assert clustering.cluster(clustering.whole_numbers(table.where("vec_id = 2"))).count() == 0
    with pytest.raises(Exception, match="beyond"):
        clustering.cluster(spark.createDataFrame([(1, [1 << 28])], "vec_id long, v array<long>")).collect()


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_decontamination", "op13_clustering"])
def test_sql_on_more_rows(spark, name):
    assert same(spark, connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01", queries.queries()[name], queries.oracle_sql()[name]) > 400
