"""Quality rules with adaptive thresholds (operator 8). DataFrame functions only.

Each document gets integer metrics. Per language and source, a mergeable sketch of each metric is kept: a
high-dynamic-range histogram, whose bucket of x keeps the seven leading bits of x, so a quantile is off by at most
1/64 of itself, at most some 3,600 buckets exist for any bigint, and two sketches merge by adding counts. Partial aggregation
merges them inside each task before anything is shuffled, so a hot source costs one row per bucket and task. The sketches of a language
and of all documents are sums of these. A group's quantiles are read off its own sketch and drawn towards those of its language, these
towards those of all, by the weight of `WEIGHT` documents, at every size: q = (n * own + WEIGHT * above) div (n + WEIGHT).
A document passes if each metric lies within its group's fences: the 90th percentile plus `FENCE` times its
distance from the median, and the 10th less likewise. No constant stands for the spread; the only tolerance is the metric's
resolution, what one occurrence more changes in this very document, and the width of the sketch's bucket.

Cases: null text counts as empty (all zeros, fails the base rule). Null lang or source form groups of their own.
Repeated rows are judged each on their own; every row gets a verdict. Extra columns are dropped by
`quality_verdicts` and kept by `quality_filter`, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, stored, words

WINDOW = 3  # words of a repeat
#: metric -> its numerator for one occurrence (a repeat is two windows) and the column it is a share of: together its resolution in a document.
STEPS = {
    "symbol_pm": (1000, "n_words"), "bang_pm": (1000, "n_words"), "dup_line_pm": (1000, "n_lines"), "repeat_pm": (2 * WINDOW * 1000, "n_words"),
    "upper_pm": (1000, "word_chars"), "word_len_c": (100, "n_words"),
}
TENTHS = (1, 5, 9)  # the quantiles read
FENCE = 3  # distances from the median beyond the outer tenths
WEIGHT = 30  # documents that the level above counts as
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def document_metrics(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc rows (all columns under `doc`) with the base counts and the metrics, in one pass without a shuffle."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    base = base.withColumn("w", words(F.col("doc.text"))).withColumn("n_words", F.size("w").cast("long"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    grams = F.transform(
        F.sequence(F.lit(1), F.col("n_words").cast("int") - (window - 1)),
        lambda i: F.xxhash64(*[F.element_at("w", i + k) for k in range(window)]),
    )
    base = (
        base.withColumn("lines", lines)
        .withColumn("grams", F.when(F.col("n_words") >= window, grams).otherwise(F.array().cast("array<bigint>")))
        .withColumn("distinct_grams", F.size(F.array_distinct("grams")))
    )
    # Windows that occur twice or more: sort (hash, position), keep neighbours of equal hash, return to position order.
    ordered = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    base = base.withColumn("s", F.when(F.size("grams") > F.col("distinct_grams"), ordered))
    near = lambda x, i, k: F.coalesce(F.get("s", i + k)["g"] == x["g"], F.lit(False))
    hits = F.sort_array(F.transform(F.filter("s", lambda x, i: near(x, i, 1) | near(x, i, -1)), lambda x: x["i"]))
    base = base.withColumn("hits", F.when(F.col("s").isNotNull(), hits))
    # Each hit covers `window` words from its position; overlaps count once.
    covered = F.aggregate(
        F.col("hits"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )
    n, chars = F.col("n_words"), F.col("word_chars")
    per_mille = lambda x, of: F.floor(x * 1000 / of).cast("long")
    positive = F.greatest(n, F.lit(1))
    return (
        base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
        .withColumn("n_symbols", _removed(text, SYMBOLS).cast("long"))
        .withColumn("n_lines", F.greatest(F.size("lines"), F.lit(1)).cast("long"))
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
        .withColumn("base_failed", (n < 50) | (100 * F.col("n_repeat_words") > 50 * n))
        .withColumn("symbol_pm", per_mille(F.col("n_symbols"), positive))
        .withColumn("bang_pm", per_mille(_removed(text, "!"), positive))
        .withColumn("dup_line_pm", per_mille(F.col("n_dup_lines"), F.col("n_lines")))
        .withColumn("repeat_pm", per_mille(F.col("n_repeat_words"), positive))
        .withColumn("upper_pm", per_mille(_removed(text, UPPER), F.greatest(chars, F.lit(1))))
        .withColumn("word_len_c", F.floor(chars * 100 / positive).cast("long"))
        .drop("w", "lines", "grams", "distinct_grams", "s", "hits")
    )


def sketch_bucket(x: Column) -> Column:
    """Lowest value of x's bucket: x with all but its seven leading bits cleared."""
    drop = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return F.when(x < 128, x).otherwise(F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop))


def adaptive_thresholds(metrics: DataFrame, fence: int = FENCE, weight: int = WEIGHT) -> DataFrame:
    """_k_lang, _k_source (keys of null's own) and a struct (low, high) for each metric, of every group that has a document past the base rule."""
    long = metrics.where(~F.col("base_failed")).select(
        F.col("_lang").alias("lang"), F.col("_source").alias("source"),
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), sketch_bucket(F.col(m)).alias("bucket")) for m in STEPS])),
    )
    return fences_of(long.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")), fence, weight)


def _points(sketch: DataFrame, *key: str) -> DataFrame:
    """total and the tenths of each key's sketch, q1, q5 and q9. A partition of these windows is one sketch: some 3,600 rows at most."""
    merged = sketch.groupBy(*key, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*key, "metric")
    cum = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda tenths: F.min(F.when(10 * F.col("upto") >= tenths * F.col("total"), F.col("bucket"))).alias(f"q{tenths}")
    return cum.groupBy(*key, "metric").agg(F.max("total").alias("total"), *[at(x) for x in TENTHS])


def _drawn(own: DataFrame, above: DataFrame, on: list[str], weight: int) -> DataFrame:
    """own's tenths drawn towards those of the level above, joined on `on` (null is a value) and the metric."""
    up = above.select(*[F.col(x).alias(f"_a_{x}") for x in (*on, "metric", *(f"q{t}" for t in TENTHS))])
    same = reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(f"_a_{x}")) for x in (*on, "metric")])
    drawn = {f"q{t}": F.expr(f"(total * q{t} + {int(weight)} * _a_q{t}) div (total + {int(weight)})") for t in TENTHS}
    return own.join(up, same).withColumns(drawn).drop(*up.columns)


def fences_of(leaf: DataFrame, fence: int = FENCE, weight: int = WEIGHT) -> DataFrame:
    """Merges the leaf sketches upwards by adding counts, draws each level's tenths towards those above and sets the fences of the groups."""
    languages = _drawn(_points(leaf, "lang"), _points(leaf), [], weight)
    groups = _drawn(_points(leaf, "lang", "source"), languages, ["lang"], weight)
    low, mid, high = (F.col(f"q{t}") for t in TENTHS)
    width = F.expr(f"q{TENTHS[2]} div 64")  # a bucket is named by its lowest value
    fences = groups.select("lang", "source", "metric", F.struct((low - fence * (mid - low)).alias("low"), (high + width + fence * (high - mid)).alias("high")).alias("f"))
    made = [F.max(F.when(F.col("metric") == m, F.col("f"))).alias(m) for m in STEPS]
    return fences.groupBy(F.col("lang").alias("_k_lang"), F.col("source").alias("_k_source")).agg(*made)


def judged(docs: DataFrame, keep: list[str], fence: int = FENCE, weight: int = WEIGHT) -> DataFrame:
    """The columns `keep` of docs under `doc`, with the metrics and `kept`.

    The metrics are written once and read twice (for the sketches and for the verdicts), as they cost more than anything else here.
    """
    m = document_metrics(docs)
    m = stored(m.withColumn("doc", F.struct(*[F.col("doc").getField(c) for c in keep])).withColumns({"_lang": F.col("doc.lang"), "_source": F.col("doc.source")}), "quality")
    # One row a group; the planner broadcasts them only while they are under the session's threshold.
    fences = adaptive_thresholds(m, fence, weight).select("_k_lang", "_k_source", F.struct(*STEPS).alias("_f"))
    out = m.join(fences, F.col("_lang").eqNullSafe(F.col("_k_lang")) & F.col("_source").eqNullSafe(F.col("_k_source")), "left")
    f = F.col("_f")
    step = {x: F.ceil(F.lit(one) / F.greatest(F.col(of), F.lit(1))).cast("long") for x, (one, of) in STEPS.items()}
    inside = reduce(lambda a, b: a & b, [F.col(x).between(f[x]["low"] - step[x], f[x]["high"] + step[x]) for x in STEPS])
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def quality_verdicts(docs: DataFrame, **params) -> DataFrame:
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged(docs, ["doc_id", "lang", "source"], **params).select(F.col("doc.doc_id").alias("doc_id"), *cols)


def quality_filter(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns."""
    return judged(docs, docs.columns, **params).where("kept").select("doc.*")
