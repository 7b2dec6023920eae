"""Totals at every grain: global, document, book, chapter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from .books import canon, canonical_name


def sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in R.COUNTERS]


def combined() -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in R.COMBINED]).alias("combined")


def finished(df: DataFrame) -> DataFrame:
    """Adds the derived columns: combined, its divisibility, chapters and verses by kind."""
    return df.withColumn("combined", combined()).withColumn("divisible_by_7", F.pmod("combined", F.lit(7)) == 0).withColumn(
        "chapters", F.col("psalm_chapter_titles") + F.col("numeric_chapter_lines")
    ).withColumn("verses", F.col("implicit_psalm_verse_1") + F.col("numbered_verse_lines"))


def total(events: DataFrame) -> DataFrame:
    """One row, zeros for no events."""
    return finished(events.agg(*sums()))


def per_document(events: DataFrame) -> DataFrame:
    return finished(events.groupBy("doc_id").agg(*sums()))


def grains(located: DataFrame) -> DataFrame:
    """The counters at every grain from one aggregation: grain is `all`, `document`, `book` or `chapter`; keys that a grain lacks are null. No events, no rows."""
    keys = [F.col(c) for c in ("doc_id", "book", "chapter")]
    sets = {"all": [], "document": keys[:1], "book": keys[1:2], "chapter": keys[1:]}
    level = {0b111: "all", 0b011: "document", 0b101: "book", 0b100: "chapter"}  # bits of the keys that a grain leaves out
    names = F.create_map(*[F.lit(x) for kv in level.items() for x in kv])
    found = located.groupingSets(list(sets.values()), *keys).agg(*sums(), F.grouping_id().cast("int").alias("level"))
    return found.select(names[F.col("level")].alias("grain"), "doc_id", "book", "chapter", *R.COUNTERS, combined())


def per_book(booked: DataFrame) -> DataFrame:
    return booked.groupBy("book").agg(F.sum("chapter_numbers").alias("chapters"), F.sum("verse_numbers").alias("verses"))


def comparison(booked: DataFrame, show_all: bool = False) -> DataFrame:
    """Canon beside the counts found; only differing books unless show_all, which adds the front matter too."""
    found = per_book(booked)
    left = canon(booked.sparkSession).withColumnsRenamed({"chapters": "exp_chapters", "verses": "exp_verses"})
    if show_all:
        left = left.unionByName(booked.sparkSession.sql(f"select 0 ord, '{R.FRONT}' book, cast(null as int) exp_chapters, cast(null as int) exp_verses"))
    out = left.join(found, "book", "left").select(
        "ord", "book", F.coalesce("chapters", F.lit(0)).cast("long").alias("chapters"), F.coalesce("verses", F.lit(0)).cast("long").alias("verses"),
        F.col("exp_chapters").cast("long").alias("exp_chapters"), F.col("exp_verses").cast("long").alias("exp_verses"),
    )
    return out if show_all else out.where("chapters <> exp_chapters or verses <> exp_verses")


def unexpected(booked: DataFrame) -> DataFrame:
    return per_book(booked).where(F.col("book") != R.FRONT).join(F.broadcast(canon(booked.sparkSession)), "book", "left_anti")  # 66 rows


def chapter_stats(located: DataFrame, chapter: str = "chapter") -> DataFrame:
    """Every (book, chapter); verse_count counts an unnumbered first verse twice, as the rules have it, verse_count_exact once."""
    sums_ = located.groupBy("book", F.col(chapter).alias("chapter")).agg(*sums())
    return _verses(sums_)


def _verses(df: DataFrame) -> DataFrame:
    df = df.withColumn("combined", combined())
    keep = [c for c in ("book", "chapter") if c in df.columns]
    return df.select(
        *keep, (F.col("verse_numbers") + F.col("implicit_psalm_verse_1")).alias("verse_count"), F.col("verse_numbers").alias("verse_count_exact"), "verse_text_words", "combined",
        (F.pmod("combined", F.lit(7)) == 0).alias("divisible_by_7"),
    )


def one_chapter(located: DataFrame, book: str, chapter: int) -> DataFrame:
    name = canonical_name(book)
    if name is None:
        raise ValueError(f"unknown book: {book!r}")
    if chapter <= 0:
        raise ValueError(f"chapter must be positive: {chapter}")
    row = _verses(located.where((F.col("book") == name) & (F.col("chapter") == chapter)).agg(*sums()))
    return row.select(F.lit(name).alias("book"), F.lit(chapter).cast("long").alias("chapter"), *row.columns)


def chapters_divisible_by_7(located: DataFrame) -> DataFrame:
    """In canon order; chapters beyond the book's canon count are left out."""
    side = canon(located.sparkSession).select("ord", "book", F.col("chapters").alias("most"))
    hit = chapter_stats(located).join(F.broadcast(side), "book").where("divisible_by_7 and chapter between 1 and most")  # 66 rows
    return hit.select("ord", "book", "chapter", "verse_count", "verse_text_words", "combined").orderBy("ord", "chapter")
