"""Periodic runs of words by Crochemore's partition refinement (operator 11).

Positions of a text are kept in classes of equal factors, first of one word, then of two, and so on. From one length to the next only the parts that split off a
class, all but its largest one, are looked at (the smaller halves): the positions before them leave their classes, so each position moves at most log n times.
The positions of a class are linked in their order. A link over distance d that exists when factors of length d are compared is a square of primitive root,
two equal neighbours of d words; squares of one period at consecutive places make up a maximal run, whose smallest period it is.

A link notes the length at which it came up; when it goes, or at the end, it shows whether it stood at the length of its own distance, so no list of distances
has to be kept. Positions whose factor would leave the text stay where they are: they come after all others of their class and reveal nothing.
The refinement ends when no class splits. It runs in numpy over the texts of `WORDS` words at a time, inside each task; nothing is shuffled.

Cases: null, empty and wordless texts have no runs and collapse to the empty string. Very long texts are taken whole (one row, one task). Repeated rows, null and
tied doc_ids are each judged on their own text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, words

LEAST, WORDS = 12, 400_000
RUNS = "array<struct<start:long,length:long,period:long>>"


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (size[0] numbers), first[1], ..."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _heads(*keys: np.ndarray) -> np.ndarray:
    """True where one of the sorted keys changes."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


class Classes:
    """Positions in classes: each class is a segment of `order`, its positions are linked ascending by `after` and `before` (-1: none)."""

    def __init__(self, cls: np.ndarray):
        n = len(cls)
        self.cls = cls
        self.order = np.argsort(cls, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        amount = int(cls.max()) + 1 if n else 0
        self.size, self.start = np.zeros(n, np.int64), np.zeros(n, np.int64)  # never more classes than positions
        self.size[:amount] = np.bincount(cls, minlength=amount)
        self.start[1:amount] = np.cumsum(self.size[: amount - 1]) if amount else 0
        self.amount = amount
        self.after, self.before, self.born = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.ones(n, np.int64)
        self.mark = np.zeros(n, bool)  # for sets of positions, empty between uses
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        self._link(self.order, cls[self.order], 1)

    def _link(self, at: np.ndarray, of: np.ndarray, length: int) -> None:
        """at: positions sorted by their class `of` and themselves."""
        joined = of[1:] == of[:-1]
        self.before[at], self.after[at] = -1, -1
        self.after[at[:-1][joined]], self.before[at[1:][joined]] = at[1:][joined], at[:-1][joined]
        self.born[at] = length

    def show(self, at: np.ndarray, length: int | None) -> None:
        """Notes the links out of these positions that stood at the length of their distance; they go at `length`, or never."""
        at = at[self.after[at] >= 0]
        d = self.after[at] - at
        good = d >= self.born[at] if length is None else (d >= self.born[at]) & (d < length)
        if good.any():
            self.squares.append((at[good], d[good]))

    def outside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The positions of a that are not in b."""
        self.mark[b] = True
        left = a[~self.mark[a]]
        self.mark[b] = False
        return left

    def leave(self, at: np.ndarray, old: np.ndarray, new: np.ndarray, length: int) -> None:
        """The positions `at` go from the classes `old` to the new classes `new`."""
        o = np.lexsort((at, old))
        p, c = at[o], old[o]
        # out of the lists: stretches of neighbours go at once
        head = np.ones(len(p), bool)
        head[1:] = self.after[p[:-1]] != p[1:]
        tail = np.append(head[1:], True)
        left, right = self.before[p[head]], self.after[p[tail]]
        self.show(p, length)
        self.show(left[left >= 0], length)
        has = left >= 0
        self.after[left[has]], self.born[left[has]] = right[has], length
        self.before[right[right >= 0]] = left[right >= 0]
        # to the end of the old class's segment
        first = np.flatnonzero(_heads(c))
        which, many = c[first], np.diff(np.append(first, len(c)))
        begin = self.start[which] + self.size[which] - many
        area = _spread(begin, many)
        stay = self.outside(self.order[area], p)
        vacated = self.place[p][self.place[p] < np.repeat(begin, many)]
        self.order[vacated], self.place[stay] = stay, vacated
        o = np.lexsort((at, new, old))
        p, c = at[o], new[o]
        self.order[area], self.place[p] = p, area
        self.size[which] -= many
        self.cls[p] = c
        first = np.flatnonzero(_heads(c))
        self.start[c[first]], self.size[c[first]] = area[first], np.diff(np.append(first, len(c)))
        self._link(p, c, length)


def _split(k: Classes, small_ones: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """Refines to factors of `length` by the positions of the small classes; returns those of the next small classes."""
    i = small_ones[~first[small_ones]]
    j = i - 1
    many = k.size[k.cls[j]] > 1
    i, j = i[many], j[many]
    if not len(j):
        return j
    cj, ci = k.cls[j], k.cls[i]
    o = np.lexsort((ci, cj))
    j, cj, ci = j[o], cj[o], ci[o]
    head = _heads(cj, ci)
    part = np.flatnonzero(head)
    size, of = np.diff(np.append(part, len(j))), cj[part]
    top = np.flatnonzero(_heads(of))  # first part of each class
    owner = np.cumsum(_heads(of)) - 1
    rest = k.size[of[top]] - np.add.reduceat(size, top)
    largest = np.maximum.reduceat(size, top)
    keeps = np.zeros(len(part), bool)  # the parts that stay as their class, where the rest is smaller
    big = np.flatnonzero((size == largest[owner]) & (rest < largest)[owner])
    keeps[big[_heads(owner[big])]] = True
    goes = ~keeps
    new = np.cumsum(goes) - 1 + k.amount
    k.amount += int(goes.sum())
    gone = np.repeat(goes, size)
    at, old, to = j[gone], cj[gone], np.repeat(new, size)[gone]
    apart = np.flatnonzero((rest > 0) & (rest < largest))
    if len(apart):  # the rest leaves: it is no larger than the part that stays
        who = of[top][apart]
        others = k.outside(k.order[_spread(k.start[who], k.size[who])], j)
        whose = k.cls[others]
        at, old, to = np.concatenate([at, others]), np.concatenate([old, whose]), np.concatenate([to, np.searchsorted(who, whose) + k.amount])
        k.amount += len(who)
    if len(at):
        k.leave(at, old, to, length)
    return at


def squares(cls: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and root length of every square of primitive root. cls: word numbers, different ones in each text; end: of each position the end of its text."""
    if not len(cls):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.append(True, end[1:] != end[:-1])
    k = Classes(cls)
    moved, length = np.arange(len(cls)), 1
    while len(moved):
        length += 1
        moved = _split(k, moved, first, length)
    k.show(np.arange(len(cls)), None)
    at, d = (np.concatenate(x) for x in zip(*k.squares)) if k.squares else (np.zeros(0, np.int64),) * 2
    whole = at + 2 * d <= end[at]
    return at[whole], d[whole]


def runs_of(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the maximal runs of each text's words, by start, then period."""
    number, codes = count(), []
    for t in texts:
        seen: defaultdict = defaultdict(number.__next__)
        codes += map(seen.__getitem__, t)
    size = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(size)
    at, d = squares(np.array(codes, np.int64), np.repeat(ends, size))
    o = np.lexsort((at, d))
    at, d = at[o], d[o]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(at):
        head = np.ones(len(at), bool)
        head[1:] = (d[1:] != d[:-1]) | (at[1:] != at[:-1] + 1)
        s, e = np.flatnonzero(head), np.append(np.flatnonzero(head)[1:], len(at)) - 1
        length = at[e] - at[s] + 2 * d[s]
        owner = np.searchsorted(ends, at[s], side="right")
        for k, a, n, q in zip(owner.tolist(), (at[s] - (ends - size)[owner]).tolist(), length.tolist(), d[s].tolist()):
            out[k].append((a, n, q))
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def kept(n: int, runs: list[tuple[int, int, int]]) -> list[bool]:
    """False for the words that a run contains after its first period."""
    change = [0] * (n + 1)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    depth, out = 0, []
    for x in change[:n]:
        depth += x
        out.append(depth == 0)
    return out


def find(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, runs of at least `least` words (array of start, length, period by start and period) and collapsed, the text's words without those that repeat a run's
    first period, joined by one space."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def done(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = [[r for r in runs if r[1] >= least] for runs in runs_of(texts)]
        left = [b" ".join([w for w, k in zip(t, kept(len(t), runs)) if k] if runs else t) for t, runs in zip(texts, found)]
        listed = [[{"start": a, "length": n, "period": q} for a, n, q in runs] for runs in found]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(listed, kind), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in small(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                ids.append(i)
                texts.append(t.split() if t else [])  # bytes split at ASCII white space alone
                size += len(texts[-1])
                if size >= WORDS:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield done(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """The query's input: in a tenth of the documents, drawn by the checksum of doc_id, the words from one on repeat a stretch; other texts stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w, g = F.col("_w"), F.floor(h / 10)
    d = docs.withColumn("_w", F.when(h % 10 == 0, words(F.col("text"))))
    n = F.size(w)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    pick = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
    looped = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), pick), " ")
    return d.select("doc_id", F.when((h % 10 == 0) & (n > 0), looped).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Runs as counts, the greatest run, and checksums."""
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    start, length, period = -best["s"], best["length"], -best["p"]
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
