"""Column functions over one stripped line. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def strip(raw: Column) -> Column:
    return F.btrim(F.coalesce(raw, F.lit("")), F.lit(R.STRIPPED))


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(R.TOKEN), F.lit(0))


def token_count(s: Column) -> Column:
    return F.regexp_count(F.coalesce(s, F.lit("")), F.lit(R.TOKEN)).cast("long")


def is_digits(s: Column) -> Column:
    return s.rlike(R.DIGITS)


def is_verse(s: Column) -> Column:
    return s.rlike(R.VERSE)


def is_psalm_title(s: Column) -> Column:
    return s.rlike(R.PSALM)


def is_stanza(s: Column) -> Column:
    return s.isin(R.STANZAS)


def _starts(s: Column, first: str) -> Column:
    """A cheap test before a pattern whose matches all begin with one of these characters."""
    return F.substring(s, 1, 1).isin(*first)


def is_heading(s: Column) -> Column:
    return _starts(s, "TtAaMmSsſDd") & s.rlike("(?iud)^(?:" + "|".join(R.HEADINGS).replace(r"\b", R.NO_WORD_AFTER) + ")")


def is_colophon(s: Column) -> Column:
    body = "|".join(R.COLOPHONS).replace(r".+\bfrom\b", r".*[^\p{L}\p{M}\p{Nd}\p{Pc}]from" + R.NO_WORD_AFTER).replace(r"\b", R.NO_WORD_AFTER)
    return _starts(s, "[OoWwTtUuIi") & s.rlike("(?iud)(?:" + body + ")")


def is_title(s: Column) -> Column:
    return (s >= "A") & (s < "[") & (s.isin(*R.TITLE_LINES) | s.rlike("(?d)^(?:" + "|".join(R.TITLE_PATTERNS) + r")\z"))


def verse_body(s: Column) -> Column:
    return F.regexp_extract(s, R.VERSE, 2)


def verse_number(s: Column) -> Column:
    """Digits of the leading verse number, without leading zeros ('' is 0); null if the line is no verse. Text, so no number is too long."""
    return F.when(is_verse(s), F.ltrim(F.regexp_extract(s, R.VERSE, 1), F.lit("0")))


def category(s: Column) -> Column:
    return category_of(s, is_digits(s), is_stanza(s), is_verse(s), is_heading(s))


def category_of(s: Column, digits: Column, stanza: Column, verse: Column, heading: Column) -> Column:
    """category of a line whose first facts are known already."""
    return (
        F.when(s == "", "other").when(digits, "chapter").when(stanza, "psalm_119_division").when(verse, "verse").when(heading, "psalm_heading")
        .when(is_colophon(s), "colophon").when(is_title(s), "book_title").when(s.rlike(r"\p{L}"), "unclassified_text").otherwise("other")
    )


def line_counts(s: Column) -> dict[str, Column]:
    """The six counters of one line on its own; the psalm ones are always 0 here."""
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    verse, digits = is_verse(s), is_digits(s)
    zero = F.lit(0).cast("long")
    return {
        "text_words": F.when(digits | verse, zero).otherwise(token_count(s)), "verse_text_words": F.when(verse & ~digits, token_count(verse_body(s))).otherwise(zero),
        "psalm_heading_words": zero, "psalm_119_division_words": zero, "chapter_numbers": one(digits), "verse_numbers": one(verse & ~digits),
    }


def labelled_tokens(s: Column) -> Column:
    """array<struct<category, token>>: a chapter number, or a verse number and its words, or text words."""
    tag = lambda name, arr: F.transform(arr, lambda t: F.struct(F.lit(name).alias("category"), t.alias("token")))
    return (
        F.when(is_digits(s), tag("chapter_number", F.array(s)))
        .when(is_verse(s), F.concat(tag("verse_number", F.array(F.regexp_extract(s, R.VERSE, 1))), tag("verse_text_word", tokens(verse_body(s)))))
        .otherwise(tag("text_word", tokens(s)))
    )
