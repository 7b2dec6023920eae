"""Centroid clustering with Drake's adaptive distance bounds (operator 13): exact Lloyd rounds on integer vectors.

Each vector carries its centroid, an upper bound of the distance to it, lower bounds of the distances to its next `NEAR` centroids, and one lower bound for
all that remain. When centroids move, the bounds move with them. If the upper bound lies under every lower bound, the vector stays without a distance
being computed; if it lies under all from the z-th on, only the z centroids before are measured; only where no such z exists are all. Certifying is strict
and bounds are rounded outwards, distances are exact integers, so the result is that of full scans, ties to the smaller number included.
The number of bounds adapts: a round keeps as many as the last one had a use for, at least one.

Each round is a pass over the rows as the last one stored them (vector and bounds side by side, so nothing is joined or shuffled); the sums of the rows that changed
their centroid are made up inside each task, and one row a task, centroid and component meets the others. The driver holds k centroids.

Cases: vectors that are null, have another number of components than `size`, or a null, NaN or infinite one take no part. First centroids are the k vectors of
smallest hash, those of one vec_id by their components, those without vec_id last; with fewer vectors than k there are as many centroids. Repeated rows count
each. Components beyond `LIMIT` raise an OverflowError, as squared distances then leave 64 bits. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, small, stored_at

SIZE, CENTROIDS, ROUNDS, SALT, NEAR, LIMIT = 64, 8, 10, "3", 4, 1 << 27
STATE = "vec_id long, v array<long>, was int, own int, up double, near array<int>, low array<double>, used int"


def whole_numbers(table: DataFrame, size: int = SIZE, scale: int = 1024) -> DataFrame:
    """vec_id and v, the components as integers floor(scale * x), of the vectors that take part."""
    e = F.col("embedding")
    ok = (F.size(e) == size) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def first_centroids(rows: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    top = rows.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k)
    return np.array([r["v"] for r in top.select("v").collect()], np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _over(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + 2**-50)


def _under(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - 2**-50)


def _up(a):
    return np.nextafter(a, np.inf)


def _down(a):
    return np.nextafter(a, -np.inf)


class Bounds:
    """The state of a block of vectors."""

    def __init__(self, own: np.ndarray, up: np.ndarray, near: np.ndarray, low: np.ndarray):
        self.own, self.up, self.near, self.low = own, up, near, low

    @classmethod
    def unknown(cls, n: int, b: int) -> Bounds:
        return cls(np.full(n, -1, np.int32), np.full(n, np.inf), np.zeros((n, b), np.int32), np.full((n, b + 1), -np.inf))

    def narrowed(self, b: int) -> Bounds:
        """With b near centroids; the bounds of the others join the remainder's."""
        if b >= self.near.shape[1]:
            return self
        return Bounds(self.own, self.up, self.near[:, :b], np.hstack([self.low[:, :b], self.low[:, b:].min(1, keepdims=True)]))

    def moved(self, drift: np.ndarray) -> None:
        """The centroids moved by these distances, rounded up."""
        self.up = _up(self.up + drift[self.own])
        b = self.near.shape[1]
        self.low[:, :b] = _down(self.low[:, :b] - drift[self.near])
        self.low[:, b] = _down(self.low[:, b] - drift.max())

    def certified(self) -> np.ndarray:
        """The least z with up under all lower bounds from the z-th on; one more than there are bounds, if there is none."""
        least = np.minimum.accumulate(self.low[:, ::-1], 1)[:, ::-1]
        under = np.hstack([self.up[:, None] < least, np.ones((len(self.up), 1), bool)])
        return under.argmax(1)

    def assign(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Makes own the nearest centroid of each vector; returns the z that each needed, bounds + 1 for a full scan."""
        b, used = self.near.shape[1], np.zeros(len(x), np.int32)
        open_ = np.flatnonzero(self.certified() > 0) if (self.own >= 0).all() else np.arange(len(x))
        if len(open_) and (self.own >= 0).all():  # the distance to the own centroid first
            self.up[open_] = _over(_squared(x[open_], c[self.own[open_]]))
            z = self.certified()[open_]
            used[open_] = z
            for n in range(1, b + 1):
                self._among(open_[z == n], x, c, n)
            open_ = open_[z == b + 1]
        used[open_] = b + 1
        self._all(open_, x, c)
        return used

    def _among(self, rows: np.ndarray, x: np.ndarray, c: np.ndarray, n: int) -> None:
        """The own centroid and the first n of the near ones, by distance and number."""
        if not len(rows):
            return
        who = np.hstack([self.own[rows, None], self.near[rows, :n]])
        far = np.stack([_squared(x[rows], c[who[:, j]]) for j in range(n + 1)], 1)
        order = np.lexsort((who, far), axis=1)
        who, far = np.take_along_axis(who, order, 1), np.take_along_axis(far, order, 1)
        self.own[rows], self.up[rows] = who[:, 0], _over(far[:, 0])
        self.near[rows, :n], self.low[rows, :n] = who[:, 1:], _under(far[:, 1:])

    def _all(self, rows: np.ndarray, x: np.ndarray, c: np.ndarray) -> None:
        if not len(rows):
            return
        far = np.stack([_squared(x[rows], one) for one in c], 1)
        order = np.argsort(far, axis=1, kind="stable")
        far, b = np.take_along_axis(far, order, 1), self.near.shape[1]
        self.own[rows], self.up[rows] = order[:, 0], _over(far[:, 0])
        self.near[rows], self.low[rows, :b] = order[:, 1 : b + 1], _under(far[:, 1 : b + 1])
        self.low[rows, b] = _under(far[:, b + 1]) if far.shape[1] > b + 1 else np.inf


def _matrix(col: pa.Array, kind, n: int) -> np.ndarray:
    return np.array(col.flatten().to_numpy(zero_copy_only=False), kind).reshape(n, -1)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1), kind))


def _pass(c: np.ndarray, drift: np.ndarray | None, b: int, last: bool):
    """One assignment of all rows to the centroids c, which moved by drift (None: nothing is known yet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 4096):
            n = batch.num_rows
            x = _matrix(batch.column("v"), np.int64, n)
            if drift is None:
                if n and np.abs(x).max(initial=0) > LIMIT:
                    raise OverflowError(f"a component lies beyond {LIMIT}")
                state = Bounds.unknown(n, b)
            else:
                state = Bounds(*(np.array(batch.column(k).to_numpy(zero_copy_only=False)) for k in ("own", "up")), _matrix(batch.column("near"), np.int32, n), _matrix(batch.column("low"), np.float64, n)).narrowed(b)
                state.moved(drift)
            was = state.own.copy()
            used = state.assign(x, c)
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(state.own, pa.int32()), pa.array(_squared(x, c[state.own]), pa.int64())], ["vec_id", "cluster", "distance"])
            else:
                cols = [batch.column("vec_id"), batch.column("v"), pa.array(was, pa.int32()), pa.array(state.own, pa.int32()), pa.array(state.up), _lists(state.near, pa.int32()), _lists(state.low, pa.float64()), pa.array(used, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "was", "own", "up", "near", "low", "used"])

    return run


def _changes(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """What the rows that changed their centroid add to each centroid's sum and count, and the most bounds any row needed."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = np.zeros((k, size + 1), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            was, own, used = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("was", "own", "used"))
            most, turned = max(most, int(used.max())), np.flatnonzero(was != own)
            x = _matrix(batch.column("v").take(pa.array(turned)), np.int64, len(turned)) if len(turned) else np.zeros((0, size), np.int64)
            x = np.hstack([x, np.ones((len(x), 1), np.int64)])
            np.add.at(total, own[turned], x)
            left = was[turned] >= 0
            np.subtract.at(total, was[turned][left], x[left])
        j, at = np.nonzero(total)
        cols = [pa.array(np.append(j, k), pa.int32()), pa.array(np.append(at, 0), pa.int32()), pa.array(np.append(total[j, at], 0), pa.int64()), pa.array([*[0] * len(j), most], pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, ["c", "at", "total", "used"])

    rows = state.select("v", "was", "own", "used").mapInArrow(add, "c int, at int, total long, used int")
    out, used = np.zeros((k + 1, size + 1), np.int64), 0
    for r in rows.groupBy("c", "at").agg(F.sum("total").alias("total"), F.max("used").alias("used")).collect():  # (k + 1) * (size + 1) rows at most
        out[r["c"], r["at"]], used = r["total"], max(used, r["used"])
    return out[:k, :size], out[:k, size], used


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT, near: int = NEAR, log: list | None = None) -> DataFrame:
    """vectors: vec_id, v (equal numbers of integers). Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid (array<long>).

    log, if given, gets (bounds kept, centroids measured in full scans' place) of each round, for tests and tuning.
    """
    spark = vectors.sparkSession
    kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    c = first_centroids(vectors, k, salt)
    if not len(c):
        return spark.createDataFrame([], kind)
    k, size = c.shape
    b = max(1, min(near, k - 1)) if k > 1 else 0
    sums, counts = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
    state, path, drift = vectors.select("vec_id", "v"), None, None
    for _ in range(rounds):
        after, place = stored_at(state.mapInArrow(_pass(c, drift, b, False), STATE), "clusters")
        if path:
            removed(spark, path)
        state, path = after, place
        plus, more, used = _changes(state, k, size)
        sums, counts = sums + plus, counts + more
        if log is not None:
            log.append((b, used))
        fresh = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], c)
        drift, c = _over(_squared(fresh, c)), fresh
        b = max(min(b, used), min(b, 1))
    done, _ = stored_at(state.mapInArrow(_pass(c, drift, b, True), "vec_id long, cluster int, distance long"), "clustered")
    if path:
        removed(spark, path)
    found = {r["cluster"]: r["d"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    about = spark.createDataFrame([(j, d, sum(found.values()), c[j].tolist()) for j, d in found.items()], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # k rows


def digest(clustered: DataFrame) -> DataFrame:
    """The centroid's components as a checksum."""
    line = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return clustered.withColumn("centroid_sha256", F.sha2(line, 256)).drop("centroid")
