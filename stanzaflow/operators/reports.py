"""Classifier samples and the diagnostic listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from . import chunks
from .machine import by_line, in_chunks


def classified(lines: DataFrame) -> DataFrame:
    s = lines.withColumn("stripped", T.strip(F.col("raw")))
    return s.withColumn("category", T.category(F.col("stripped")))


def line_samples(lines: DataFrame, limit: int = 3) -> DataFrame:
    """First lines of every category in order of (doc_id, lineno); categories without lines give one row of nulls. Blank lines count as `other`."""
    limit = limit if limit and limit > 0 else 3
    w = Window.partitionBy("category").orderBy("doc_id", "lineno")
    top = classified(lines).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    dim = lines.sparkSession.createDataFrame([(c,) for c in R.CATEGORIES], "category string")
    return dim.join(top, "category", "left").select("category", F.col("n").cast("long").alias("n"), "doc_id", "lineno", "stripped")


def psalms_range(lines: DataFrame) -> DataFrame:
    """doc_id, first, last: line numbers strictly between the two marker lines; no row where a marker is missing or they are reversed."""
    s = T.strip(F.col("raw"))
    ends = lines.groupBy("doc_id").agg(F.min(F.when(s == R.PSALMS_START, F.col("lineno"))).alias("a"), F.min(F.when(s == R.PSALMS_END, F.col("lineno"))).alias("b"))
    return ends.where("a < b").select("doc_id", (F.col("a") + 1).alias("first"), (F.col("b") - 1).alias("last"))


def with_implicit(events: DataFrame) -> DataFrame:
    """Adds looks_implicit, the look-ahead rule of the classifier: unlike the parser's, the last line never is."""
    return events.withColumn("looks_implicit", F.col("unmarked") & F.col("next").isNotNull() & F.col("next_opens"))


def psalms_unclassified(events: DataFrame) -> DataFrame:
    """Both ends are read off a window of the document, or of its chunks' rows, so its lines are joined with nothing else."""
    e = with_implicit(events)
    ends = {"_a": F.when(F.col("stripped") == R.PSALMS_START, F.col("lineno")), "_b": F.when(F.col("stripped") == R.PSALMS_END, F.col("lineno"))}
    if in_chunks(e):
        e = chunks.carried(e, {f"least{k}": F.min(c) for k, c in ends.items()}, {k: chunks.anywhere(f"least{k}") for k in ends})
    else:
        e = e.withColumns({k: F.min(c).over(Window.partitionBy("doc_id")) for k, c in ends.items()})
    e = e.where("lineno > _a and lineno < _b and not looks_implicit and category = 'unclassified_text'")
    return e.select("doc_id", "lineno", "raw", "prev", "next")


def numeric_chapters(events: DataFrame) -> DataFrame:
    return events.where("numeric_chapter_lines > 0").select("doc_id", "lineno", "raw", "prev_raw", "next_raw")


def text_word_lines(events: DataFrame) -> DataFrame:
    return events.where("text_words > 0").select("doc_id", "lineno", "raw", F.col("text_words").alias("tokens"), F.col("category").alias("classification"))


def text_word_bucket() -> Column:
    return F.when(F.col("classification") == "book_title", "book_titles_cover").when(F.col("classification") == "colophon", "colophon").otherwise("other")


def text_word_groups(events: DataFrame) -> DataFrame:
    """Three groups, each listed even at 0."""
    found = text_word_lines(events).groupBy(text_word_bucket().alias("bucket")).agg(F.sum("tokens").alias("t"))
    dim = events.sparkSession.createDataFrame([("book_titles_cover",), ("colophon",), ("other",)], "bucket string")
    return dim.join(found, "bucket", "left").select("bucket", F.coalesce("t", F.lit(0)).cast("long").alias("tokens"))


def other_breakdown(events: DataFrame) -> DataFrame:
    rest = text_word_lines(events).where("classification not in ('book_title', 'colophon')")
    return rest.groupBy("classification").agg(F.sum("tokens").alias("tokens")).orderBy("classification")


def psalm_heading_lines(events: DataFrame) -> DataFrame:
    keep = (F.col("kind") == "psalm_heading") | ((F.col("kind") == "implicit_psalm_opening") & (F.col("psalm_heading_words") > 0))
    return events.where(keep).select("doc_id", "lineno", "raw", "kind", F.col("psalm_heading_words").alias("tokens"))


def psalm_heading_total(events: DataFrame) -> DataFrame:
    return psalm_heading_lines(events).agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.count("*").alias("n_lines"))


def psalm_debug(events: DataFrame) -> DataFrame:
    """Each `PSALM n` line with the next two non-blank lines and their categories."""
    w = by_line(events)
    have = [F.lead("lineno", k).over(w) for k in (1, 2)]
    cols = {f"{c}_{k}": F.lead(c, k).over(w) for k in (1, 2) for c in ("lineno", "stripped", "category", "raw")}
    if in_chunks(events):
        e = events.withColumns({"_1": have[0], "_2": have[1], **cols})
        cols = {name: F.coalesce(F.col(name), chunks.following(int(name[-1]), [F.col("_1"), F.col("_2")], F.col("follow"), name[:-2])) for name in cols}
        events = e.withColumns(cols)
    else:
        events = events.withColumns(cols)
    return events.where(T.is_psalm_title(F.col("stripped"))).select("doc_id", "lineno", "raw", "stripped", "category", *cols)
