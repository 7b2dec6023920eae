"""The reports as text: every printed line is a row (part, doc_id, lineno, k, report_line), in that order.

Parts follow each other: a report's head, its entries in the order of documents and lines, its closing lines. The sink sorts and prints.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from . import books, reports, totals

COLUMNS = ("part", "doc_id", "lineno", "k", "report_line")
NONE = "(none)"


def _block(rows: DataFrame, part: int, lines: list[Column | str] | Column, doc_id: Column | int = 0, lineno: Column | int = 0) -> DataFrame:
    """The lines that each row prints; null lines are left out."""
    texts = lines if isinstance(lines, Column) else F.array(*[F.lit(x) if isinstance(x, str) else x for x in lines])
    at = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    made = rows.select(F.lit(part).alias("part"), at(doc_id).alias("doc_id"), at(lineno).alias("lineno"), F.posexplode(texts).alias("k", "report_line"))
    return made.where("report_line is not null")


def _report(*blocks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, blocks)


def in_order(report: DataFrame) -> DataFrame:
    return report.orderBy(*COLUMNS[:-1])


def _entries(rows: DataFrame, part: int, lines: list[Column | str]) -> DataFrame:
    return _block(rows, part, lines, F.col("doc_id"), F.col("lineno"))


def totals_report(events: DataFrame) -> DataFrame:
    named = lambda label, c: F.format_string(label + ": %d", c)
    return _block(totals.total(events), 0, [
        named("Text words", "text_words"), named("Verse text words", "verse_text_words"), named("Psalm heading words", "psalm_heading_words"),
        named("Psalm 119 division words", "psalm_119_division_words"), named("Chapter numbers", "chapter_numbers"), named("Verse numbers", "verse_numbers"), "", "Debug:",
        named("  PSALM chapter titles", "psalm_chapter_titles"), named("  Numeric chapter lines", "numeric_chapter_lines"), named("  Implicit Psalm verse 1", "implicit_psalm_verse_1"),
        named("  Numbered verse lines", "numbered_verse_lines"), "", named("Combined total", "combined"), F.format_string("Divisible by 7: %s", "divisible_by_7"),
    ])


def chapter_report(located: DataFrame, book: str, chapter: int) -> DataFrame:
    return _block(totals.one_chapter(located, book, chapter), 0, [
        F.format_string("Book: %s", "book"), F.format_string("Chapter: %d", "chapter"), F.format_string("Verse count: %d", "verse_count"),
        F.format_string("Verse text words: %d", "verse_text_words"), F.format_string("Chapter total: %d", "combined"), F.format_string("Divisible by 7: %s", "divisible_by_7"),
    ])


def divisible_report(located: DataFrame) -> DataFrame:
    return _block(totals.chapters_divisible_by_7(located), 0, [F.concat_ws("\t", "book", "chapter", "combined")], F.col("ord"), F.col("chapter"))


def samples_report(lines: DataFrame, limit: int = 3) -> DataFrame:
    """part counts the categories."""
    rows = reports.line_samples(lines, limit).groupBy("category").agg(F.sort_array(F.collect_list(F.struct("n", "stripped"))).alias("found"))  # at most `limit` a category
    shown = F.transform("found", lambda x: F.when(x["n"].isNull(), "  (no lines matched in this file)").otherwise(F.concat(F.lit("  "), x["stripped"])))
    order = F.array_position(F.array(*[F.lit(c) for c in R.CATEGORIES]), F.col("category"))
    return _block(rows, 0, F.concat(F.array(F.format_string("== %s ==", "category")), shown, F.array(F.lit(""))), order)


# --- fixed values: labels of the printed groups ---
BUCKETS = {"book_titles_cover": "book titles / cover", "colophon": "colophons", "other": "other"}


def text_words_report(events: DataFrame) -> DataFrame:
    """Lines, classes, groups and the total come from one aggregation by grouping sets, so that the events are read once."""
    spark, kind = events.sparkSession, "doc_id long, lineno long, raw string, tokens long, classification string"
    none = spark.createDataFrame([(None, None, None, 0, c) for c in ("book_title", "colophon", "other")], kind).withColumn("real", F.lit(0))  # each group is listed even at 0
    rows = reports.text_word_lines(events).withColumn("real", F.lit(1)).unionByName(none).withColumn("bucket", reports.text_word_bucket())
    keys = [F.col(c) for c in ("doc_id", "lineno", "raw", "bucket", "classification")]
    line, by_class, by_bucket = keys, keys[3:], keys[3:4]
    level = {"line": 0, "class": 0b11100, "bucket": 0b11101, "all": 0b11111}  # bits of the keys that a level leaves out
    found = rows.groupingSets([line, by_class, by_bucket, []], *keys).agg(F.sum("tokens").alias("t"), F.sum("real").alias("n"), F.grouping_id().alias("level"))
    order = lambda names, c: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c))
    label, other = F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv]), (F.col("bucket") == "other") & (F.col("n") > 0)
    printed = {
        "line": ((1, [F.format_string("L%d\t%d tok\t%s", "lineno", "t", "classification"), F.concat(F.lit("  "), "raw"), ""], F.col("doc_id"), F.col("lineno")),),
        "class": ((5, [F.format_string("  %s: %d tokens", "classification", "t")], order(sorted(R.CATEGORIES), "classification"), 0),),
        "bucket": ((3, [F.format_string("%s: %d tokens", label[F.col("bucket")], "t")], order(BUCKETS, "bucket"), 0), (4, [F.when(other, ""), F.when(other, "--- other (by classification) ---")], 0, 0)),
        "all": ((0, [F.format_string("Lines contributing to text_words (%d lines, %d tokens)", "n", "t"), ""], 0, 0), (2, ["--- Subtotals (by LineClassifier bucket) ---"], 0, 0), (6, ["", F.format_string("Total text_words: %d", "t")], 0, 0)),
    }
    real = {"line": F.col("n") > 0, "class": other, "bucket": F.lit(True), "all": F.lit(True)}
    lines = F.coalesce(*[F.when((F.col("level") == level[name]) & real[name], F.concat(*[_numbered(*x) for x in parts])) for name, parts in printed.items()])
    return found.select(F.explode(lines).alias("x")).select("x.*").where("report_line is not null")


def _numbered(part: int, lines: list[Column | str], doc_id: Column | int, lineno: Column | int) -> Column:
    """The lines that a row prints, as an array of the report's rows."""
    at = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("long")
    return F.array(*[F.struct(F.lit(part).alias("part"), at(doc_id).alias("doc_id"), at(lineno).alias("lineno"), F.lit(k).alias("k"), (F.lit(x) if isinstance(x, str) else x).alias("report_line")) for k, x in enumerate(lines)])


def psalm_headings_report(events: DataFrame) -> DataFrame:
    rows, whole = reports.psalm_heading_lines(events), reports.psalm_heading_total(events)
    return _report(
        _block(whole, 0, [F.format_string("Lines contributing to psalm_heading_words (%d lines)", "n_lines"), ""]),
        _entries(rows, 1, [F.format_string("L%d\t%d tok", "lineno", "tokens"), F.concat(F.lit("  "), "raw"), ""]),
        _block(whole, 2, [F.format_string("Total psalm_heading_words: %d", "tokens")]),
    )


def unclassified_report(lines: DataFrame, events: DataFrame) -> DataFrame:
    rows, spans = reports.psalms_unclassified(events), reports.psalms_range(lines).agg(F.count("*").alias("n"))
    or_none = lambda c: F.coalesce(F.col(c), F.lit(NONE))
    found = rows.agg(F.count("*").alias("n")).crossJoin(F.broadcast(spans.select(F.col("n").alias("spans"))))  # one row each
    total = F.when(F.col("spans") > 0, F.format_string("Total: %d unclassified_text line(s) in Psalms body", "n"))
    return _report(
        _entries(rows, 1, [F.format_string("L%d", "lineno"), F.concat(F.lit("  prev: "), or_none("prev")), F.concat(F.lit("  raw:  "), "raw"), F.concat(F.lit("  next: "), or_none("next")), ""]),
        _block(found, 2, [F.coalesce(total, F.lit("Could not find BOOK OF PSALMS. … THE PROVERBS. span."))]),
    )


def comparison_report(booked: DataFrame, show_all: bool = False) -> DataFrame:
    """part 0: the canon's books, 1: books outside it, 2: the front matter, 3: the closing lines.

    Books are counted once and joined with the canon; the closing lines are a grouping set over these rows, one a book.
    """
    side = books.canon(booked.sparkSession).select("ord", "book", F.col("chapters").alias("exp_chapters"), F.col("verses").alias("exp_verses"))
    found, front = totals.per_book(booked).where("book is not null"), F.col("book") == R.FRONT
    if show_all:
        side = side.unionByName(booked.sparkSession.sql(f"select 0 ord, '{R.FRONT}' book, 0 exp_chapters, 0 exp_verses"))
    else:
        found = found.where(~front)
    rows = side.join(found, "book", "full").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("chapters", "verses")})
    rows = rows.withColumn("part", F.when(front, 2).when(F.col("ord").isNull(), 1).otherwise(0))
    extra, wrong = F.col("part") == 1, (F.col("chapters") != F.col("exp_chapters")) | (F.col("verses") != F.col("exp_verses"))
    texts = (
        F.when(front, F.format_string("%s: chapters %d, verses %d", "book", "chapters", "verses"))
        .when(extra, F.format_string("%s: chapters %d, verses %d (unexpected book bucket)", "book", "chapters", "verses"))
        .when(F.lit(show_all) | wrong, F.format_string("%s: chapters %d (expected %d), verses %d (expected %d)", "book", "chapters", "exp_chapters", "verses", "exp_verses"))
    )
    place = F.when(extra, F.row_number().over(Window.partitionBy("part").orderBy("book")) - 1).otherwise(0)  # rows are books
    rows = rows.select("part", F.when(F.col("part") == 0, F.col("ord")).otherwise(0).cast("long").alias("doc_id"), place.cast("long").alias("lineno"), texts.alias("report_line"), (extra | wrong).cast("int").alias("wrong"))
    keys = [F.col(c) for c in COLUMNS if c != "k"]
    rows = rows.groupingSets([keys, []], *keys).agg(F.sum("wrong").alias("n"), F.grouping_id().alias("level"))
    last = F.lit(f"Printed all {len(R.CANON)} books (+ front matter).") if show_all else F.format_string("Mismatches vs canon: %d", "n")
    book = F.array(F.struct("part", "doc_id", "lineno", F.lit(0).alias("k"), "report_line"))
    lines = F.when(F.col("level") == 0, book).otherwise(_numbered(3, ["", f"Canonical books: {len(R.CANON)}", last], 0, 0))
    return rows.select(F.explode(lines).alias("x")).select("x.*").where("report_line is not null")


def numeric_chapters_report(events: DataFrame) -> DataFrame:
    rows = reports.numeric_chapters(events)
    near = lambda label, c: F.concat(F.lit(f"  {label} non-empty: "), F.coalesce(F.col(c), F.lit(NONE)))
    return _report(
        _entries(rows, 0, ["---", F.format_string("line %d: %s", "lineno", "raw"), near("previous", "prev_raw"), near("next", "next_raw")]),
        _block(rows.agg(F.count("*").alias("n")), 1, ["---", F.format_string("Total numeric chapter lines: %d", "n")]),
    )


def psalm_debug_report(events: DataFrame) -> DataFrame:
    after = lambda k: [F.format_string("  next non-empty (line %d): %s", f"lineno_{k}", f"raw_{k}"), F.format_string("    classification: %s", f"category_{k}")]
    lines = [F.format_string("line %d: %s", "lineno", "raw"), F.format_string("  classification: %s", "category")]
    lines += [F.when(F.col(f"lineno_{k}").isNotNull(), x) for k in (1, 2) for x in after(k)]
    return _entries(reports.psalm_debug(events), 0, [*lines, ""])


def _leading_number(text: str) -> int:
    """The number that a text begins with, 0 if there is none."""
    found = re.match(r"\s*([+-]?[0-9]+(?:_[0-9]+)*)", text)
    return int(found[1]) if found else 0


def command_report(lines: DataFrame, command: str = "totals", *args: str) -> DataFrame:
    """The text of one command line, an unknown command like none; raises ValueError for what a known one cannot mean."""
    from .machine import events as events_of

    events = events_of(lines)
    booked = books.with_book(events)
    if command == "chapter":
        if len(args) < 2:
            raise ValueError("Usage: chapter <Book Name> <Chapter Number>")
        if not (args[-1].isascii() and args[-1].isdigit()):
            raise ValueError("Chapter number must be a positive integer.")
        return chapter_report(books.with_chapter(booked), " ".join(args[:-1]), int(args[-1]))
    if command == "chapters-divisible-by-7":
        return divisible_report(books.with_chapter(booked))
    if command == "line-samples":
        return samples_report(lines, _leading_number(args[0]) if args else 0)
    if command == "text-words-debug":
        return text_words_report(events)
    if command == "psalm-heading-words-debug":
        return psalm_headings_report(events)
    if command == "psalms-unclassified-debug":
        return unclassified_report(lines, events)
    if command == "book-stats-debug":
        return comparison_report(booked, "--all" in args)
    if command == "numeric-chapters-debug":
        return numeric_chapters_report(events)
    if command == "psalm-debug":
        return psalm_debug_report(events)
    return totals_report(events)
