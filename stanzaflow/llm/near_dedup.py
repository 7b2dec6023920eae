"""MinHash near-dedup by fast similarity sketches (operator 2).

1. Sketch: a document's set of word shingles becomes `COORDS` coordinates. In round i every shingle is hashed to a bin
   and a value; a bin keeps its least (round, value). The first COORDS rounds place shingles at random, the next
   COORDS rounds send all shingles to one bin each, so every coordinate is filled for any set that isn't empty, and
   most sets need one or two rounds.
2. Equal sets, known by a 128-bit hash of the whole set (its sign), collapse to one node; nodes are numbered as they are written.
3. Banding: each node has one key per band of coordinates. Buckets with two nodes or more are compared in blocks (see `grouped`), and each
   block gives a spanning forest of the pairs whose sketches agree enough: at most one edge fewer than it has nodes, never
   all pairs. `MARGIN` below the threshold is over five standard deviations of the estimate.
4. Components of these edges are candidate groups. Each group's texts come together in blocks likewise, bounded by rows and by shingles, and every pair
   that isn't connected yet is settled on full shingle sets; verified links leave as a spanning forest.
5. Components of verified links, by alternating large-star and small-star steps on tables, give the result.

A link at the threshold is missed if no band agrees, 4e-7 for similarity 0.85 (25 bands of 5) and 5e-8 for 0.8 (32 of 4), or if too few of 128
coordinates do, 4e-10 and 9e-9 by the binomial tail. It is lost only if no other links join the two.

Cases: null texts and texts without words have the empty set and link with nothing. Fewer words than a shingle: the whole sequence is one
shingle. Rows that repeat a doc_id belong to the component of their own text. Rows without doc_id are not linked: their component_id is null and kept false. Very long texts are
used whole. Extra columns are ignored by `components` and kept by `deduplicated`, which links rows by number
instead: repeated and null ids are judged on their texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, scratch, small, stored, wide

COORDS, BLOCK, BLOCK_SHINGLES, HUBS, MARGIN = 128, 256, 8_000_000, 8, 0.22
#: threshold in hundredths -> (bands, rows)
BANDS = {85: (25, 5), 80: (32, 4)}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    import xxhash

    w = _WORD.findall(text.translate(_LOWER)) if text else []
    if not w:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(x) for x in w), np.uint64, len(w))
    k = min(k, len(w))
    s = np.full(len(h) - k + 1, len(w) if len(w) < k else k, np.uint64)
    for i in range(k):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    return np.unique(s)


def sketch(s: np.ndarray, t: int = COORDS) -> np.ndarray:
    """Fast similarity sketch of a set that isn't empty: t 64-bit coordinates."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    empty = np.ones(t, bool)
    for i in range(2 * t):
        v = _mix(s + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        if i < t:
            bins = (v >> np.uint64(57)).astype(np.int64) if t == 128 else ((v >> np.uint64(33)) % np.uint64(t)).astype(np.int64)
        else:
            bins = np.full(len(s), i - t)
        use = empty[bins]
        if use.any():
            # values of a later round are larger by law, so only bins still empty can change
            np.minimum.at(out, bins[use], v[use] & np.uint64(0x01FFFFFFFFFFFFFF))
            empty[bins[use]] = False
            if not empty.any():
                break
    return out


def _sketches(k: int, bands: int, rows: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for b in small(batches):
            n, sign, low, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, k)
                n.append(len(s))
                if not len(s):
                    sign.append(None), low.append(None), keys.append(None)
                    continue
                c = sketch(s)
                sign.append(xxhash.xxh3_128_digest(s.tobytes()))
                low.append(_mix(c).astype(np.uint8).tobytes())
                x, key = c[: bands * rows].reshape(bands, rows), salt
                for j in range(rows):
                    key = _mix(key + x[:, j])
                keys.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sum"), pa.array(n, pa.int64()), pa.array(sign, pa.binary()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "sum", "n_shingles", "sign", "low", "keys"])

    return run


def _forest(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (smaller, larger) of a spanning forest of the links a[i]-b[i] between positions of node."""
    up, out = list(range(len(node))), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[p] = q
            u, v = int(node[x]), int(node[y])
            out.append((min(u, v), max(u, v)))
    return out


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _alike(least: float):
    """Blocks of buckets -> spanning forest of the pairs whose sketches agree in at least that share of coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], None] = {}
        for g in groups(batches, ["key", "i", "j"]):
            if g.num_rows > 1:
                node = g.column("node").to_numpy()
                low = np.frombuffer(b"".join(g.column("low").to_pylist()), np.uint8).reshape(len(node), -1)
                a, b = [], []
                for x in range(len(node) - 1):
                    y = np.flatnonzero((low[x + 1 :] == low[x]).mean(1) >= least) + x + 1
                    a.append(np.full(len(y), x))
                    b.append(y)
                found.update(dict.fromkeys(_forest(node, np.concatenate(a), np.concatenate(b))))
            if len(found) > 20_000:
                yield _edges(list(found))
                found = {}
        yield _edges(list(found))

    return run


def _verified(k: int, num: int):
    """Blocks of groups with texts -> forest of the pairs with 100 * intersection >= num * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for g in groups(batches, ["comp", "i", "j"]):
            sets, node = [], []
            for t, sign, id_ in zip(g.column("text").to_pylist(), g.column("sign").to_pylist(), g.column("node").to_pylist()):
                s = shingle_set(t, k)
                if xxhash.xxh3_128_digest(s.tobytes()) == sign and id_ not in node[-1:]:
                    sets.append(s)
                    node.append(id_)
            if len(node) < 2:
                continue
            size = np.array([len(s) for s in sets])
            ids, inv = np.unique(np.concatenate(sets), return_inverse=True)
            owner = np.repeat(np.arange(len(sets)), size)
            inter = np.zeros((len(sets), len(sets)), np.int64)
            step = max(256, 8_000_000 // len(sets))
            order = np.argsort(inv, kind="stable")
            inv, owner = inv[order], owner[order]
            for s in range(0, len(ids), step):
                lo, hi = np.searchsorted(inv, [s, s + step])
                m = np.zeros((len(sets), min(step, len(ids) - s)), np.float32)
                m[owner[lo:hi], inv[lo:hi] - s] = 1
                inter += (m @ m.T).astype(np.int64)  # a step has fewer columns than float32 counts exactly
            union = size[:, None] + size[None, :] - inter
            a, b = np.nonzero(np.triu(100 * inter >= num * union, 1))
            yield _edges(_forest(np.array(node), a, b))

    return run


def _dealt(rows: DataFrame, key: str, pairs) -> DataFrame:
    """Each row once per pair (i, j) of the array `pairs`, gathered by key and pair."""
    cut = rows.withColumn("_p", F.explode(pairs)).select("*", F.col("_p.i").alias("i"), F.col("_p.j").alias("j")).drop("_p")
    return cut.repartition(wide(rows.sparkSession), key, "i", "j").sortWithinPartitions(key, "i", "j", "node")


def _at(i, j):
    return F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))


def _upto(n):
    return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)


def grouped(rows: DataFrame, key: str, compare) -> DataFrame:
    """(node, comp) by the links that compare finds between rows of a key. rows: key, node, n (nodes of the key), blocks (in which they are dealt) and what
    compare reads; stored, as they are read again where a large group is left open.

    First each block is compared inside, together with about `HUBS` rows of its key that visit all its blocks, so
    a large group of near copies becomes one component at the cost of its rows. Then only the rows outside the largest component of
    their key are left, and meet all rows of the key in pairs of blocks: every pair is compared, or already connected.
    """
    n, blocks, own = F.col("n"), F.col("blocks"), F.xxhash64("node")
    hub = F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(n / HUBS)) == 0
    visits = F.when((blocks > 1) & hub, _upto(blocks)).otherwise(F.array(F.pmod(own, blocks)))
    first = _dealt(rows, key, F.transform(visits, lambda i: _at(i, i)))
    comps = connected(first.mapInArrow(compare, "a long, b long"))
    parts = rows.where(blocks > 1).select(key, "node", "n", "blocks").distinct().join(comps.withColumnRenamed("comp", "_c"), "node", "left").select(key, "node", "n", "blocks", F.coalesce("_c", "node").alias("part"))
    main = parts.groupBy(key, "part").agg(F.count("*").alias("size")).groupBy(key).agg(F.max(F.struct("size", "part")).alias("_m"))
    rest = parts.join(main, key).withColumn("_rest", F.ceil(blocks * (n - F.col("_m.size")) / n)).where("_rest > 0")
    rest = stored(rest.select(key, "node", "_rest", (F.col("part") != F.col("_m.part")).alias("_out")), "rest")
    if rest.isEmpty():
        return comps
    i, j = F.pmod(own, F.col("_rest")), F.pmod(own, blocks)
    seen = F.transform(_upto(F.col("_rest")), lambda x: _at(x, j))
    pairs = F.when(F.col("_out"), F.array_union(seen, F.transform(_upto(blocks), lambda x: _at(i, x)))).otherwise(seen)
    more = _dealt(rows.where(blocks > 1).join(rest, [key, "node"]), key, pairs).mapInArrow(compare, "a long, b long")
    return connected(comps.select(F.col("comp").alias("a"), F.col("node").alias("b")).unionByName(more))


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest node reachable. Large-star and small-star steps until nothing changes."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Joined on another key than grouped by: so both sides are shuffled for the join itself, and a node with very many neighbours can be split.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.bitwise_not("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.withColumn("k", F.bitwise_not("a")).join(least, "k").where("b > a").select(F.col("m").alias("a"), "b").distinct()  # larger neighbours to the least
        down = large.groupBy("b").agg(F.min("a").alias("m")).select(F.bitwise_not("b").alias("k"), "m")
        small = large.withColumn("k", F.bitwise_not("b")).join(down, "k").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = stored(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def linked(docs: DataFrame, k: int, num: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, sign) of every row, and (sign, first, comp) of every node: its least doc_id and its component."""
    bands, rows = BANDS[num]
    kind = "doc_id long, sum long, n_shingles long, sign binary, low binary, keys array<bigint>"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("sum"))
    made = stored(texts.mapInArrow(_sketches(k, bands, rows), kind), "sketches")
    with scratch(docs.sparkSession):
        ids = made.where("doc_id is not null and sign is not null")
        # One row a node, its least doc_id with its sketch (ties: any, they carry the same one); copies collapse before the shuffle.
        rep = ids.groupBy("sign").agg(F.min(F.struct("doc_id", "sum", "n_shingles", "low", "keys")).alias("r"))
        # The numbers hold because they are written once: what a lost task had not committed, another numbers again.
        rep = stored(rep.select(F.monotonically_increasing_id().alias("node"), "sign", F.col("r.doc_id").alias("rep"), "r.sum", "r.n_shingles", "r.low", "r.keys"), "nodes")
        nodes = rep.select("node", F.explode(F.array_distinct("keys")).alias("key"))
        sizes = nodes.groupBy("key").agg(F.count("*").alias("n"))
        crowd = nodes.join(sizes.where("n > 1"), "key").join(rep.select("node", "low"), "node")
        comps = stored(grouped(stored(crowd.select("key", "node", "n", F.ceil(F.col("n") / BLOCK).alias("blocks"), "low"), "crowd"), "key", _alike(num / 100 - MARGIN)), "candidates")
        # blocks of texts are bounded by their rows and by what their sets hold
        sized = comps.join(rep.select("node", "sign", "rep", "sum", "n_shingles"), "node")
        most = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
        stats = sized.groupBy("comp").agg(F.count("*").alias("n"), most.alias("blocks"))
        # texts are merged at every size: a member table small enough to broadcast today is not so tomorrow
        member = sized.join(stats, "comp").join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), ["rep", "sum"])
        # a row that is repeated brings its text as often; one a node goes on
        member = stored(member.groupBy("comp", "node", "sign", "n", "blocks").agg(F.first("text").alias("text")), "members")
        links = grouped(member, "comp", _verified(k, num))
        of = rep.select("node", "sign", F.col("rep").alias("first")).join(links, "node", "left")
        of = stored(of.select("sign", "first", F.coalesce("comp", "node").alias("comp")), "linked", keep=True)
    return made.select("doc_id", "n_shingles", "sign"), of


def components(docs: DataFrame, k: int = 3, num: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row; links have 100 * intersection >= num * union."""
    rows, of = linked(docs, k, num)
    least = of.groupBy("comp").agg(F.min("first").alias("component_id"))
    label = of.join(least, "comp").select("sign", "component_id")
    # rows without a sign have nothing to look up, and would all meet in one task
    out = rows.where("sign is not null").join(label, "sign", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).drop("sign")
    out = out.unionByName(rows.where("sign is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80) -> DataFrame:
    """One row of each component of rows, that of the least doc_id (ids that are null last, then in row order), with docs' own columns.

    Rows are numbered first and linked by number, so repeated and null ids are judged on their texts alone. A row without both id and words goes.
    """
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("_row")), "numbered")
    found, comps = linked(rows.select(F.col("_row").alias("doc_id"), F.col("doc.text").alias("text")), k, num)
    ids = rows.select("_row", F.col("doc.doc_id").alias("id"))
    of = found.select(F.col("doc_id").alias("_row"), "sign").join(ids, "_row")
    first = F.struct(F.col("id").isNull(), "id", "_row").alias("f")
    one = of.where("sign is not null").join(comps.select("sign", "comp"), "sign").groupBy("comp").agg(F.min(first).alias("f")).select(F.col("f._row").alias("_keep"))
    kept = one.unionByName(of.where("sign is null and id is not null").select(F.col("_row").alias("_keep")))
    return rows.join(kept, rows["_row"] == kept["_keep"], "left_semi").select("doc.*")
