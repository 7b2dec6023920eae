"""Quality selection by importance resampling (operator 5).

Two generative models of hashed word n-grams (one and two words, `BUCKETS` buckets): one of the target text (documents labelled good and
not toxic), one of all text. A document's weight is the ratio of its likelihoods, its logarithm the sum over its
features. Adding Gumbel noise and taking the k largest draws k documents without replacement by weight.

Counts cover all documents; a model is `BUCKETS` numbers, whatever the input. The k-th largest key is found exactly by counting 16 bits at a time, so
nothing is sorted or sent to one task. Ties at the k-th key are all selected.

Cases: null and empty texts have no feature and log ratio 0. Very long texts are counted and scored whole; an empty table gives no rows. Documents without a label count as raw only; a doc_id labelled more than once is target if any
label says so. Repeated rows share their noise. With no target document, an empty label table among them, all ratios are 0. Null quality or toxic: no target, not toxic. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, words

BUCKETS, SHARE, SEED, PRIOR = 10_000, 0.85, 7, 1.0


def hashed(df: DataFrame) -> DataFrame:
    """Adds w (words) and f (buckets of one- and two-word features)."""
    df = df.withColumn("w", words(F.col("text")))
    two = lambda x, i: F.pmod(F.xxhash64(x, F.get("w", i + 1)), F.lit(BUCKETS)).cast("int")
    one = F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    pairs = F.slice(F.transform("w", two), 1, F.greatest(F.size("w") - 1, F.lit(0)))
    return df.withColumn("f", F.concat(one, pairs)).drop("w", "text")


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest of the non-negative bigint column `key`, by four counts of at most 65,536 rows."""
    prefix, rest = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("key", shift).bitwiseAND(F.lit(65535)).alias("digit")
        part = keys if shift == 48 else keys.where(F.shiftright("key", shift + 16) == prefix)
        for r in sorted(part.groupBy(digit).count().collect(), key=lambda r: -r["digit"]):
            if r["count"] >= rest:
                prefix = (prefix << 16) | r["digit"]
                break
            rest -= r["count"]
    return prefix


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, log_ratio, noisy, selected of every row; ceil(share * rows) are selected."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("_good")).distinct()
    rows = docs.select("doc_id", "text")
    # merged at every size: a label table small enough to broadcast today is not so tomorrow
    target = hashed(rows.join(good.hint("merge"), rows["doc_id"] == good["_good"], "left_semi").select("doc_id", "text"))
    raw = hashed(rows)
    both = raw.select("f", F.lit(False).alias("target")).unionByName(target.select("f", F.lit(True).alias("target")))
    weights = log_ratios_of(both)
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2**53))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weights)
        for b in batches:
            f = b.column("f")
            n = f.value_lengths().to_numpy().astype(np.int64)
            total, some = np.zeros(len(n)), n > 0
            if some.any():  # each document's sum by itself, whatever stands beside it
                total[some] = np.add.reduceat(w[f.flatten().to_numpy()], (np.cumsum(n) - n)[some])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(np.round(total, 6))], ["doc_id", "n_features", "log_ratio"])

    scored = raw.select("doc_id", "f").mapInArrow(score, "doc_id long, n_features long, log_ratio double").withColumn("_gumbel", -F.log(-F.log(u)))
    scored = scored.withColumn("noisy", F.col("log_ratio") + F.col("_gumbel")).drop("_gumbel")
    scored = stored(scored.withColumn("key", (F.floor(F.col("noisy") * 1e6) + F.lit(2**61)).cast("long")), "resampling")
    k = math.ceil(share * scored.count())
    cut = kth_largest(scored.select("key"), k) if k else 0
    return scored.select("doc_id", "n_features", "log_ratio", "noisy", (F.col("key") >= cut).alias("selected"))


def log_ratios_of(both: DataFrame) -> list[float]:
    """Target rows appear twice in `both`, once as raw text: raw counts take the rows not marked."""
    # the outer form, as the planner would compute f once more for a filter that it infers from the inner one
    n = both.select("target", F.explode_outer("f").alias("b")).where("b is not null").groupBy("b").agg(F.count_if(~F.col("target")).alias("raw"), F.count_if("target").alias("good")).collect()  # BUCKETS rows at most
    raw, good = [PRIOR] * BUCKETS, [PRIOR] * BUCKETS
    for r in n:
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    a, b = sum(raw), sum(good)
    return [math.log(t / b) - math.log(x / a) if b > PRIOR * BUCKETS else 0.0 for t, x in zip(good, raw)]
