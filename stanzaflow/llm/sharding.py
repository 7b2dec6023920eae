"""Uniform shuffle into shards of exact size (operator 3). DataFrame functions only.

Law `rows`: shard sizes differ by one row at most. A communication matrix says how many rows of input partition i go
to shard j; it is drawn from its law, the multivariate hypergeometric (probabilities in double precision), so that "permute locally, send by the
matrix, permute again" is a uniform permutation of all rows. Row and column sums of the matrix are exact whatever is drawn. Input tasks are joined
without a shuffle to at most `PARTS` partitions, so the matrix, which is drawn on the driver from one count per partition and sent to all tasks, has at most `PARTS` x shards cells
at any size.

Whole documents move, with all their columns. The first permutation sorts each input partition by a draw, in its own task; the
rows are then written once, each with its partition and its rank there. Rows are addressed by these, never by a value, so no key can be
hot and equal rows stay apart. The exchange is a shuffle of the documents by shard and cell, which is the second permutation too: each
row draws a cell of its shard, the cells' counts give each its first slot, and rows are ranked inside their cell. So no task holds a shard.

Equal texts share text_crc32; law `rows` ties nothing to the text, and a group larger than a shard could not be kept
whole under it. Cases: null text has 16 bytes and the CRC of no bytes (0). Null and repeated ids are rows like any other. With fewer
rows than shards some shards are empty. Very long texts move whole. `sharded` keeps all columns of the documents, `shuffle_into_shards` adds
the digest columns, which are taken from the documents where they arrive.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SHARDS, SEED, CELL_ROWS, PARTS = 40, 20, 2_000, 16_384


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """One draw: inversion outwards from the mode, in about as many steps as the standard deviation."""
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    lg = math.lgamma
    comb = lambda n, k: lg(n + 1) - lg(k + 1) - lg(n - k + 1)
    top = math.exp(comb(good, mode) + comb(bad, draws - mode) - comb(total, draws))
    u = rng.random() - top
    if u <= 0:
        return mode
    down, up, pd, pu = mode, mode, top, top
    while down > low or up < high:
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode  # where rounding left a remainder, some 1e-12 of the draws


def shard_sizes(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row i: how many rows of partition i go to each shard. Row sums are counts, column sums the shard sizes."""
    rng, room, out = random.Random(seed), shard_sizes(sum(counts), shards), []
    for n in counts:
        rest, row = sum(room), []
        for j in range(shards):
            k = hypergeometric(rng, room[j], rest - room[j], n)
            row.append(k)
            rest -= room[j]
            n -= k
        room = [a - b for a, b in zip(room, row)]
        out.append(row)
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc (a struct of all columns of docs), shard, slot of every row."""
    spark = docs.sparkSession
    rows = docs.coalesce(PARTS).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("_at"))
    # Permuted in the task that read them, without a shuffle; the second id counts along the new order.
    rows = rows.withColumn("_draw", F.xxhash64("_at", F.lit(seed))).sortWithinPartitions("_draw", "_at").select("doc", F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("_part", F.shiftright("_at", 33)).withColumn("_rank", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stored(rows, "shard-rows")  # fixes each row's address before counts are taken
    per_part = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # PARTS rows at most
    parts = sorted(per_part)
    matrix = communication_matrix([per_part[p] for p in parts], shards, seed)
    ends = [[sum(m[: j + 1]) for j in range(shards)] for m in matrix]
    sent = spark.createDataFrame(list(zip(parts, ends)), "_part long, _ends array<long>")
    shard = F.size(F.filter("_ends", lambda e: e <= F.col("_rank")))
    cells = max(1, math.ceil(sum(per_part.values()) / shards / CELL_ROWS))
    placed = rows.join(F.broadcast(sent), "_part").withColumn("shard", shard.cast("int"))  # PARTS rows at most
    placed = placed.withColumn("_u", F.xxhash64("_at", F.lit(seed + 1))).withColumn("_cell", F.pmod("_u", F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    start = placed.groupBy("shard", "_cell").count().select("shard", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    again = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_u", "_at")) - 1
    return placed.select("doc", "shard", "_cell", "_u", "_at").withColumn("_k", again).join(start, ["shard", "_cell"]).select(  # a row per cell, dealt as the rows are
        "doc", "shard", (F.col("_start") + F.col("_k")).cast("long").alias("slot")
    )


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and doc, the whole document, of every row."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    return sharded(docs, shards, seed).select(
        F.col("doc.doc_id").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "doc",
    )
