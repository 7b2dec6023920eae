"""Approximate nearest neighbours by a hierarchical k-means tree (operator 7).

1. A tree of k-means splits is fitted on the driver to a bounded sample, `SAMPLE` vectors on average: each row is in it or not by a draw of its own, so nothing
   is sorted for it. Leaves hold about `LEAF` rows each while the sample has eight rows a leaf or more, so up to about a million vectors; above that the tree
   stays as large as the sample allows and leaves grow with the table, which step 4 bounds by shelves. Every row goes down the tree to its leaf.
2. Queries visit leaves best-bin-first: a priority queue over tree nodes, ordered by distance to the node's centre.
3. Calibration: for `PROBES` rows of the sample the exact neighbours are found against all rows, and the number of leaves to visit widens until `RECALL`
   of them lie in visited leaves. That number holds for all queries.
4. Leaves lie side by side on shelves of `SHELF` bytes of vectors at most (a leaf may span several). A query goes once to each shelf that holds a leaf it visits,
   with a bit for each leaf there. A task holds one shelf; queries stream by in slices of `SLICE` and keep their best few, with exact scores, from leaf to leaf.
   The best of all shelves are ranked. So no task's memory depends on the number of queries or visits.

Scores are cosines in double precision of the original vectors, each summed in the same order wherever it is computed, so equal vectors
tie exactly and ties go to the smaller vec_id.

Cases: vectors that are null, zero, or hold a null, infinite or NaN component take no part, nor do rows without vec_id or with another dimension than
most rows of the table have (ties: the smaller); queries of another dimension have no answer.
Repeated vec_ids: each row is a candidate; a query id that repeats is searched once, by its smallest vector, and rows of its own id are no
candidates. Fewer candidates than k: all are returned. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import runs, small, stored, wide

SAMPLE, LEAF, BRANCH, PROBES, RECALL, BLOCK, SEED = 20_000, 400, 8, 200, 0.97, 2_000, 3
SHELF, SLICE = 16 << 20, 512


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        for j in range(k):
            if (m := x[own == j]).size:
                v = m.sum(0)
                c[j] = v / (np.linalg.norm(v) or 1)
    return c


class Tree:
    """Nodes as lists: children of an inner node, or the number of its leaf."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = BRANCH, seed: int = 0):
        self.centres: list[np.ndarray] = []  # of a node's children
        self.children: list[list[int]] = []  # node numbers; -1 - leaf for a leaf
        self.leaves = 0
        least = max(branch, len(x) // max(1, leaves))
        self._grow(x, least, branch, np.random.default_rng(seed))

    def _grow(self, x, least, branch, rng) -> int:
        if len(x) <= 2 * least or len(np.unique(x, axis=0)) <= branch:
            self.leaves += 1
            return -self.leaves
        at = len(self.centres)
        c = _kmeans(x, branch, rng)
        self.centres.append(c)
        self.children.append([])
        own = (x @ c.T).argmax(1)
        self.children[at] = [self._grow(x[own == j], least, branch, rng) for j in range(branch)]
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), np.int64) if not self.centres else np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            at, rows = todo.pop()
            own = (x[rows] @ self.centres[at].T).argmax(1)
            for j, child in enumerate(self.children[at]):
                r = rows[own == j]
                if len(r):
                    if child < 0:
                        out[r] = -child
                    else:
                        todo.append((child, r))
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order."""
        if not self.centres:
            return [1]
        out, queue = [], [(-2.0, 0)]
        while queue and len(out) < most:
            _, at = heapq.heappop(queue)
            if at < 0:
                out.append(-at)
                continue
            for s, child in zip((self.centres[at] @ q).tolist(), self.children[at]):
                heapq.heappush(queue, (-s, child))
        return out


def _unit(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of one dimension without nulls, their lengths, and their directions."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = col.flatten().to_numpy(zero_copy_only=False)
    x = x.reshape(len(col), len(x) // max(1, len(col)))
    n = np.sqrt((x * x).sum(1))
    return x, n, x / n[:, None]


def _best(q, qn, qu, q_id, x, n, u, ids, k: int) -> list[tuple[int, int, float, int]]:
    """(query, vec_id, exact score, row of x) of each query's k best among x."""
    out = []
    for s in range(0, len(q), 256):
        near = qu[s : s + 256] @ u.T
        near[q_id[s : s + 256, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(near, s):
            cut = np.partition(row, -k)[-k] if len(row) > k else -np.inf
            c = np.flatnonzero((row >= cut - 1e-9) & (row > -np.inf))
            score = (x[c] * q[i]).sum(1) / (n[c] * qn[i])
            for j in np.lexsort((ids[c], -score))[:k]:
                out.append((int(q_id[i]), int(ids[c[j]]), float(score[j]), int(c[j])))
    return out


def _met(q, qn, qu, q_id, seen, leaves, k: int) -> pa.RecordBatch:
    """Each query's k best of the leaves it visits; seen: query x leaf, leaves: (x, n, u, ids) of each."""
    best, found = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
    step = max(1, (1 << 20) // max(1, q.shape[1]))
    for j, leaf in enumerate(leaves):
        asks = np.flatnonzero(seen[:, j])
        for s in range(0, len(leaf[0]) if len(asks) else 0, BLOCK):
            x, n, u, ids = (c[s : s + BLOCK] for c in leaf)
            near = qu[asks] @ u.T
            near[q_id[asks, None] == ids[None, :]] = -np.inf
            cut = best[asks, -1] - 1e-9
            more = near.max(1) >= cut
            go, near, cut = asks[more], near[more], cut[more]
            if near.shape[1] > k and len(go):
                cut = np.maximum(cut, np.partition(near, -k, axis=1)[:, -k] - 1e-9)
            r, c = np.nonzero((near >= cut[:, None]) & (near > -np.inf))
            if not len(r):
                continue
            parts = [(r[a : a + step], c[a : a + step]) for a in range(0, len(r), step)]
            score = np.concatenate([(x[b] * q[go[a]]).sum(1) / (n[b] * qn[go[a]]) for a, b in parts])
            who, score, ids = np.r_[go[r], np.repeat(go, k)], np.r_[score, best[go].ravel()], np.r_[ids[c], found[go].ravel()]
            order = np.lexsort((ids, -score, who))
            who = who[order]
            first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
            kept = rank < k
            best[who[kept], rank[kept]], found[who[kept], rank[kept]] = score[order[kept]], ids[order[kept]]
    r, c = np.nonzero(best > -np.inf)
    return pa.RecordBatch.from_arrays([pa.array(q_id[r]), pa.array(found[r, c]), pa.array(best[r, c])], ["query_id", "vec_id", "score"])


PAIRS = "query_id long, vec_id long, score double"


def _pairs(rows: list[tuple[int, int, float]], extra: list | None = None) -> pa.RecordBatch:
    a, b, c = zip(*rows) if rows else ((), (), ())
    cols, names = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"]
    return pa.RecordBatch.from_arrays(cols + ([pa.array(extra, pa.int64())] if extra is not None else []), names + (["leaf"] if extra is not None else []))


def usable(table: DataFrame, size: int | None = None) -> tuple[DataFrame, int]:
    """Rows that take part, and their dimension: that of most of them, if none is given."""
    v = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).where(ok)
    if size is None:
        most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        size = most["d"] if most else 0
    return rows.where(F.size("embedding") == size), size


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(table: DataFrame, queries: DataFrame, k: int = 5, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """queries: rows of table (vec_id, embedding), any number."""
    spark = table.sparkSession
    base, size = usable(table)
    total = base.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A draw by row, not by value: copies of one vector or id are drawn apart.
    drawn = base.withColumn("draw", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.lit(SEED)), 11))
    drawn = sorted(drawn.where(F.col("draw") <= int(min(1.0, SAMPLE / total) * 2**53)).collect(), key=lambda r: r["draw"])  # SAMPLE rows on average
    sample = np.array([r["embedding"] for r in drawn], np.float64).reshape(len(drawn), size)
    sample /= np.sqrt((sample * sample).sum(1))[:, None]
    tree = Tree(sample, max(1, total // leaf))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.leaf_of(_unit(b.column("embedding"))[2]), pa.int64())], ["vec_id", "embedding", "leaf"])

    rows = stored(base.mapInArrow(place, "vec_id long, embedding array<double>, leaf long").withColumn("at", F.monotonically_increasing_id()), "leaves")
    probes = list({r["vec_id"]: r["embedding"] for r in reversed(drawn)}.items())[-PROBES:]
    p_id, p = np.array([x[0] for x in probes]), np.array([x[1] for x in probes], np.float64)
    pn = np.sqrt((p * p).sum(1))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 8192):
            x, n, u = _unit(b.column("embedding"))
            ids = b.column("vec_id").to_numpy()
            found = _best(p, pn, p / pn[:, None], p_id, x, n, u, ids, k)
            leaf = b.column("leaf").to_pylist()  # by row: rows that repeat a vec_id may lie in different leaves
            yield _pairs([f[:3] for f in found], [leaf[f[3]] for f in found])

    truth = _ranked(rows.mapInArrow(exact, PAIRS + ", leaf long"), k).select("query_id", "leaf").collect()  # k rows a probe
    order = {i: {x: r for r, x in enumerate(tree.visits(v, tree.leaves), 1)} for i, v in zip(p_id.tolist(), p / pn[:, None])}
    needed = sorted(order[t["query_id"]][t["leaf"]] for t in truth) or [1]
    visits = needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]

    n = np.zeros(tree.leaves, np.int64)
    for r in rows.groupBy("leaf").count().collect():  # a row a leaf, bounded by the sample
        n[r["leaf"] - 1] = r["count"]
    per = max(1, min(SHELF // (8 * size), max(BLOCK, -(-total // wide(spark)))))
    begin, shelves = np.cumsum(n) - n, -(-total // per)
    spans = [(int(np.searchsorted(begin + n, s * per, "right")), int(np.searchsorted(begin, (s + 1) * per))) for s in range(shelves)]  # leaves of a shelf
    q = usable(queries, size)[0].repartition(wide(spark), "vec_id").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, SLICE):
            seen = np.zeros((b.num_rows, tree.leaves), bool)
            for i, v in enumerate(_unit(b.column("embedding"))[2]):
                seen[i, np.array(tree.visits(v, visits)) - 1] = True
            seen &= n > 0
            for s, (lo, hi) in enumerate(spans):
                go = np.flatnonzero(seen[:, lo:hi].any(1))
                bits = [x.tobytes() for x in np.packbits(seen[go, lo:hi], axis=1)]
                at = pa.array(go, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(go), pa.int64()), b.column("vec_id").take(at), b.column("embedding").take(at), pa.array(bits, pa.binary())], ["shelf", "vec_id", "embedding", "seen"])

    asked = q.mapInArrow(ask, "shelf long, vec_id long, embedding array<double>, seen binary").select("shelf", F.lit(True).alias("query"), "vec_id", "embedding", F.lit(0).cast("long").alias("leaf"), "seen")
    places = spark.createDataFrame([(i, int(a), int(c)) for i, (a, c) in enumerate(zip(begin, n), 1) if c], "leaf long, begin long, n long")
    kept = rows.join(F.broadcast(places), "leaf").withColumn("shelf", F.floor((F.col("begin") + F.pmod(F.xxhash64("at"), F.col("n"))) / per))
    kept = kept.select("shelf", F.lit(False).alias("query"), "vec_id", "embedding", "leaf", F.lit(None).cast("binary").alias("seen"))
    met = asked.unionByName(kept).repartitionById(shelves, F.col("shelf").cast("int")).sortWithinPartitions("shelf", "query")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the shelf
        shelf, leaves = None, []
        for (at, asks), part in runs(batches, ["shelf", "query"]):
            if at != shelf:
                shelf, held, leaves = at, [], []
            lo, hi = spans[at]
            if not asks:
                held.append(part)
                continue
            if held:
                t = pa.Table.from_batches(held)
                held, leaf = [], t.column("leaf").to_numpy()
                order = np.argsort(leaf, kind="stable")
                ends = np.searchsorted(leaf[order], np.arange(lo + 1, hi + 2))
                cols = [c[order] for c in (*_unit(t.column("embedding")), t.column("vec_id").to_numpy())]
                leaves = [tuple(c[a:b] for c in cols) for a, b in zip(ends, ends[1:])]
            for b in small([part], SLICE):
                bits = np.frombuffer(b"".join(b.column("seen").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                x, length, u = _unit(b.column("embedding"))
                yield _met(x, length, u, b.column("vec_id").to_numpy(), np.unpackbits(bits, axis=1, count=hi - lo).astype(bool), leaves, k)

    return _ranked(met.mapInArrow(meet, PAIRS), k).select("query_id", "rank", "vec_id", "score")
