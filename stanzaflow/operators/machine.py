"""The line state machine in closed form: windows over an explicit line order, one exchange on doc_id, or on (doc_id, chunk) where lines have a chunk.

A line's event depends on two flags carried from line to line: whether a psalm's unnumbered first verse is awaited, and whether a
verse number split from its body was just read. Both are read off windows: runs of digit-only lines alternate chapter / split number /
body by position, and the first flag is the last non-null of what each earlier line does to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import rules as R
from ..functions import text as T
from . import chunks


def in_chunks(rows: DataFrame) -> bool:
    return "chunk" in rows.columns


def by_line(rows: DataFrame) -> WindowSpec:
    return Window.partitionBy(*(chunks.KEYS if in_chunks(rows) else ("doc_id",))).orderBy("lineno")


def features(lines: DataFrame) -> DataFrame:
    """Non-blank lines with the regex facts, each computed once. Lines in chunks are numbered first: so the exchange moves bare lines, one for all passes over them."""
    c = F.col("stripped")
    s = lines.where(T.strip(F.col("raw")) != "")
    if in_chunks(s):
        s = s.where(F.col("doc_id").isNotNull() & F.col("chunk").isNotNull())  # as joins on them would infer for some of the passes, which then shared no exchange
        w = by_line(s)
        s = s.withColumns({"n": F.row_number().over(w), "ends": F.lead("lineno", chunks.AHEAD).over(w).isNull()})
    s = s.withColumn("stripped", T.strip(F.col("raw")))
    s = s.withColumns({"lead": F.regexp_extract(c, R.LEAD, 1), "stanza": T.is_stanza(c), "title": T.is_psalm_title(c), "heading": T.is_heading(c), "tok": T.token_count(c)})
    digits, verse = (F.col("lead") != "") & (F.length("lead") == F.length(c)), (F.col("lead") != "") & (F.length("lead") < F.length(c))
    s = s.withColumns({"digits": digits, "verse": verse})
    late = F.col("verse") & ~F.ltrim("lead", F.lit("0")).isin("", "1")  # verse 2 or later
    return s.withColumns({
        "category": T.category_of(c, F.col("digits"), F.col("stanza"), F.col("verse"), F.col("heading")),
        # the number is one token of the line, the rest are the verse's
        "body_tok": F.when(F.col("verse"), F.col("tok") - 1).otherwise(F.lit(0).cast("long")), "opens_next": late | F.col("title"),
    })


def events(lines: DataFrame) -> DataFrame:
    """One row per non-blank line: kind, the ten counters, and the neighbours that reports show. All windows share one partitioning and one order.

    Of lines in chunks each chunk starts from the state and the lines that `chunks.summaries` gives it.
    """
    f = features(lines)
    w = by_line(f)
    before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    split = in_chunks(f)
    none = F.lit(None)
    if split:
        f = f.join(chunks.summaries(f), list(chunks.KEYS))
        # only lines at a chunk's ends keep the lines around it, so what is sorted next stays as large as the lines
        f = f.withColumns({"prior": F.when(F.col("n") <= chunks.BEHIND, F.col("prior")), "follow": F.when(F.col("ends"), F.col("follow"))})
        entry = F.col("entry")
        enters_waiting, digits_before = entry >= 3, F.when(entry == 2, 2).when(entry.isin(1, 4), 1).otherwise(0)
        of_line = lambda line, c: chunks.stripped(line) if c == "stripped" else line[c]
        after = lambda c: of_line(F.get("follow", F.lit(0)), c)
        ahead = lambda c: of_line(F.try_element_at("prior", F.lit(-1)), c)
    else:
        enters_waiting, digits_before, after, ahead = F.lit(False), F.lit(0), lambda c: none, lambda c: none
    first = lambda *c: F.coalesce(*c) if split else c[0]
    next_ = lambda c, name, at_end: F.coalesce(F.lead(c).over(w), after(name), F.lit(at_end)) if split else F.coalesce(F.lead(c).over(w), F.lit(at_end))
    f = f.withColumns({
        **({} if split else {"n": F.row_number().over(w)}), "next_opens": next_("opens_next", "opens_next", True), "next_sets": next_(F.col("stanza") | F.col("title"), "sets", False),
        "prev_raw": first(F.lag("raw").over(w), ahead("raw")), "next_raw": first(F.lead("raw").over(w), after("raw")),
        "prev": first(F.lag("stripped").over(w), ahead("stripped")), "next": first(F.lead("stripped").over(w), after("stripped")),
    })
    other = F.when(~F.col("digits"), F.col("n"))  # lines that end a run of digit-only lines
    since = lambda frame: F.coalesce(F.last(other, ignorenulls=True).over(frame), -digits_before)
    f = f.withColumns({"pos": F.col("n") - since(upto), "last_pos": F.col("n") - 1 - since(before)})  # place in such a run; 0 outside
    f = f.withColumn("after_even", ~F.col("digits") & (F.col("last_pos") > 0) & (F.col("last_pos") % 2 == 0))
    sets = F.col("stanza") | F.col("title")
    f = f.withColumn(
        "turn",
        F.when(sets, F.when(~F.col("after_even"), True)).when(F.col("heading"), F.lit(None).cast("boolean")).when(F.col("verse"), False)
        .when(F.col("digits") & (F.col("pos") % 2 == 0) & F.col("next_sets"), F.lit(None).cast("boolean")).when(F.col("next_opens"), False),
    )
    turned = lambda frame, at_first: F.coalesce(F.last("turn", ignorenulls=True).over(frame), at_first)
    # after a split number, which a chunk is entered after by state 2, nothing was awaited
    f = f.withColumns({"waiting": turned(before, enters_waiting), "was_waiting": turned(w.rowsBetween(Window.unboundedPreceding, -2), (F.col("n") > 1) & enters_waiting)})
    wait, dig = F.col("waiting"), F.col("digits")
    consumed = F.when(dig, ~wait & (F.col("pos") >= 3) & (F.col("pos") % 2 == 1)).otherwise(F.col("after_even") & ~F.col("was_waiting"))
    kind = (
        F.when(consumed, "split_verse_body").when(F.col("stanza"), "psalm_119_division").when(F.col("title"), "psalm_title").when(wait & F.col("heading"), "psalm_heading")
        .when(wait & F.col("verse"), "verse_after_psalm_heading").when(wait, "implicit_psalm_opening").when(dig & (F.col("pos") % 2 == 0), "split_verse_number").otherwise("numbered_line")
    )
    f = f.withColumn("kind", kind)
    k, tok = F.col("kind"), F.col("tok")
    plain = k.isin("numbered_line", "verse_after_psalm_heading")
    opening = k == "implicit_psalm_opening"
    verse_row, opens = plain & F.col("verse") & ~dig, opening & F.col("next_opens")
    num = lambda c, v=1: F.when(c, v).otherwise(0).cast("long")
    f = f.withColumns({
        "text_words": num(plain & ~dig & ~F.col("verse"), tok),
        "verse_text_words": F.when(verse_row, F.col("body_tok")).otherwise(num((k == "split_verse_body") | opens, tok)),
        "psalm_heading_words": num((k == "psalm_heading") | (opening & ~F.col("next_opens")), tok),
        "psalm_119_division_words": num(k == "psalm_119_division", tok),
        "chapter_numbers": num((k == "psalm_title") | (plain & dig)),
        "verse_numbers": num(verse_row | opens | (k == "split_verse_number")),
        "psalm_chapter_titles": num(k == "psalm_title"), "numeric_chapter_lines": num(plain & dig), "implicit_psalm_verse_1": num(opens),
        "numbered_verse_lines": num(verse_row | (k == "split_verse_number")),
    })
    return f.select(*(("chunk", "n", "prior", "follow") if split else ()), "doc_id", "lineno", "raw", "stripped", "kind", "category", *R.COUNTERS, "digits", "prev_raw", "next_raw", "prev", "next", "next_opens", (~(F.col("stanza") | F.col("title") | F.col("heading") | F.col("digits") | F.col("verse"))).alias("unmarked"))


def assert_kinds(events_df: DataFrame) -> DataFrame:
    """Fails at run time on an event kind outside the registry."""
    ok = F.assert_true(F.col("kind").isin(*R.KINDS), F.concat(F.lit("unknown kind "), F.col("kind")))
    return events_df.where(ok.isNull())
