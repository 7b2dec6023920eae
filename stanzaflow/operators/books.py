"""Book and chapter segmentation of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from . import chunks
from .machine import by_line, in_chunks


def canon(spark: SparkSession) -> DataFrame:
    """66 fixed rows."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(R.CANON, 1)], "ord int, book string, chapters int, verses int")


def canonical_name(name: str | None) -> str | None:
    wanted = (name or "").strip(R.STRIPPED).lower()
    return next((b for b, _, _ in R.CANON if b.lower() == wanted), None)


TITLES = sorted({line for line, only_before, _, _ in R.AMBIGUOUS if not only_before})
#: a line of the ten before such a title counts only if it holds a word of the parts looked for; others count as empty, which no part spans
_WORDS = sorted({word for _, only_before, part, _ in R.AMBIGUOUS if not only_before for word in part.split()})


def before_ten(rows: DataFrame) -> Column:
    """The ten non-blank lines before, joined by spaces."""
    own = F.collect_list("stripped").over(by_line(rows).rowsBetween(-chunks.BEHIND, -1))
    if in_chunks(rows):
        both = F.concat(F.transform("prior", chunks.stripped), own)
        own = F.when(F.col("n") <= chunks.BEHIND, F.slice(both, F.greatest(F.lit(1), F.size(both) - chunks.BEHIND + 1), chunks.BEHIND)).otherwise(own)
    return F.concat_ws(" ", own)


def before_title(rows: DataFrame) -> Column:
    """The same for ambiguous titles alone, as far as it matters to them; null for other lines. `hint`: the line, if it holds a word looked for."""
    w, lines = by_line(rows), []
    for k in range(chunks.BEHIND, 0, -1):
        line = F.lag("hint", k).over(w)
        if in_chunks(rows):
            line = F.when(F.col("n") > k, line).otherwise(chunks.stripped(F.get("prior", (F.size("prior") + F.col("n") - k - 1).cast("int"))))
        lines.append(F.coalesce(line, F.lit("")))
    return F.when(F.col("stripped").isin(*TITLES), F.concat_ws(" ", *lines))


def with_book(events: DataFrame, blob: bool = False) -> DataFrame:
    """Adds book (carried forward), book_before (the line before's), and blob (the ten non-blank lines before) if asked for."""
    s = F.col("stripped")
    hint = F.when(reduce(Column.__or__, [F.contains(s, F.lit(word)) for word in _WORDS]), s)
    e = events if blob else events.withColumn("hint", hint)
    e = e.withColumn("blob", before_ten(e) if blob else before_title(e)).drop("hint")
    by_book: dict[str, list[str]] = {}
    for line, book in R.TRIGGERS.items():
        by_book.setdefault(book, []).append(line)
    start = reduce(lambda acc, kv: acc.when(s.isin(*kv[1]), kv[0]), by_book.items(), F.when(F.lit(False), ""))
    for line, only_before, part, book in R.AMBIGUOUS:
        start = start.when((s == line) & ((F.col("prev") == part) if only_before else F.contains(F.col("blob"), F.lit(part))), book)
    e = e.withColumn("book_start", start)
    e = e if blob else e.drop("blob")
    w, front = by_line(e), F.lit(R.FRONT)
    if in_chunks(e):
        e = chunks.carried(e, {"found": chunks.latest(F.col("book_start"))}, {"entered": chunks.earlier("found")})
        front = F.coalesce("entered", front)
    carried = lambda last: F.coalesce(F.last("book_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, last)), front)
    return e.withColumns({"book": carried(0), "book_before": carried(-1)}).drop("entered")


def with_chapter(booked: DataFrame) -> DataFrame:
    """Adds chapter (as the counting rules have it) and chapter_exact (split verse numbers do not count as chapters)."""
    title = F.when(F.col("kind") == "psalm_title", F.expr("try_cast(substring(stripped, 7) as bigint)"))
    number = F.expr("try_cast(stripped as bigint)")
    psalms, changed = F.col("book") == "Psalms", F.col("book") != F.col("book_before")
    w = by_line(booked)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = {"chapter": F.col("digits"), "chapter_exact": F.col("numeric_chapter_lines") > 0}
    # a line that changes the book carries its own number or none
    marks = {name: F.when(psalms, title).otherwise(F.when(c, number)) for name, c in numbered.items()}
    marks = {name: F.when(changed | mark.isNotNull(), F.struct(mark.alias("v"))) for name, mark in marks.items()}
    if not in_chunks(booked):
        return booked.withColumns({name: F.last(mark, ignorenulls=True).over(upto)["v"] for name, mark in marks.items()})
    rows = booked.withColumns({f"_{name}": mark for name, mark in marks.items()})
    rows = chunks.carried(rows, {f"last_{name}": chunks.latest(F.col(f"_{name}")) for name in marks}, {f"in_{name}": chunks.earlier(f"last_{name}") for name in marks})
    rows = rows.withColumns({name: F.coalesce(F.last(f"_{name}", ignorenulls=True).over(upto), F.col(f"in_{name}"))["v"] for name in marks})
    return rows.drop(*[f"{p}_{name}" for p in ("", "in") for name in marks])
