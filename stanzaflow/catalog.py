"""Registered queries of the counting engine, over the shaped corpus, and their SQL equivalents for DuckDB.

The SQL steps through lines with a recursive query that carries the two flags, so it shares no logic with the window form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import text as T
from .operators import books, machine, printed, reports, totals
from .plans import shaped
from .sources import lines as L


OUTSIDE = "Tobit"  # a book that the canon lacks


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def _lines(spark, sf_dir):
    return shaped.shaped_lines(_docs(spark, sf_dir))


def _events(spark, sf_dir):
    return machine.events(_lines(spark, sf_dir))


def _booked(spark, sf_dir):
    return books.with_book(_events(spark, sf_dir))


def _located(spark, sf_dir):
    return books.with_chapter(_booked(spark, sf_dir))


def _mislabelled(spark, sf_dir):
    """Labels as a caller of his own might bring them: some documents belong to a book that the canon lacks."""
    return _booked(spark, sf_dir).withColumn("book", F.when(F.col("doc_id") % 10 == 3, OUTSIDE).otherwise(F.col("book")))


def _raw_lines(spark, sf_dir):
    return L.exploded(_docs(spark, sf_dir))


def _one(spark, sf_dir):
    """The whole corpus as a single document; its chunks are small so that small tables are cut too."""
    return L.joined(_lines(spark, sf_dir), 2_000, dense=True)


def _one_located(spark, sf_dir):
    return books.with_chapter(books.with_book(machine.events(_one(spark, sf_dir))))


def _in_printed_order(report):
    """Each line with the number under which it is printed."""
    lines = report.select("doc_id", (F.col("lineno") * 10 + F.col("k")).alias("lineno"), F.col("report_line").alias("raw"))
    return L.joined(lines, 2_000).select(F.col("lineno").alias("n"), F.col("raw").alias("report_line"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "a1_line_scan": lambda p, d: _raw_lines(p, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("raw")).alias("n_chars"), F.max("lineno").alias("last_line")),
        "b_tokens": lambda p, d: _docs(p, d).select("doc_id", T.token_count(F.col("text")).alias("n_tokens"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 5), "|").alias("first_tokens")),
        "b_token_frequencies": lambda p, d: _docs(p, d).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n")),
        "b_counts": lambda p, d: _lines(p, d).select("doc_id", *[v.alias(k) for k, v in T.line_counts(T.strip(F.col("raw"))).items()]).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in R.COMBINED]),
        "b_labels": lambda p, d: _lines(p, d).select("doc_id", F.explode(T.labelled_tokens(T.strip(F.col("raw")))).alias("x")).groupBy("doc_id", F.col("x.category").alias("category")).agg(F.count("*").alias("n"), F.min("x.token").alias("first_token")),
        "c_classify": lambda p, d: reports.classified(_lines(p, d)).groupBy("category").agg(F.count("*").alias("n_lines")),
        "c_sample": lambda p, d: reports.line_samples(_lines(p, d), 3),
        "c_range": lambda p, d: reports.psalms_range(_lines(p, d)),
        "c_implicit": lambda p, d: reports.with_implicit(_events(p, d)).where("looks_implicit").select("doc_id", "lineno", "stripped"),
        "c_unclassified": lambda p, d: reports.psalms_unclassified(_events(p, d)),
        "c_neighbours": lambda p, d: _events(p, d).select("doc_id", "lineno", "prev", "next"),
        "d_events": lambda p, d: machine.assert_kinds(_events(p, d)).select("doc_id", "lineno", "kind", "category", *R.COUNTERS),
        "d_kinds": lambda p, d: _events(p, d).groupBy("kind").agg(F.count("*").alias("n"), *totals.sums()),
        "e_books": lambda p, d: books.with_book(_events(p, d), blob=True).select("doc_id", "lineno", "book", "blob"),
        "f_chapters": lambda p, d: _located(p, d).select("doc_id", "lineno", "book", "chapter", "chapter_exact"),
        "g1_totals": lambda p, d: totals.total(_events(p, d)),
        "g1_doc_totals": lambda p, d: totals.per_document(_events(p, d)),
        "g6_books": lambda p, d: totals.per_book(_booked(p, d)),
        "g7_chapter": lambda p, d: totals.one_chapter(_located(p, d), "genesis", 1),
        "g7_absent_chapter": lambda p, d: totals.one_chapter(_located(p, d), "Jude", 99),
        "g8_divisible_by_7": lambda p, d: totals.chapters_divisible_by_7(_located(p, d)),
        "g8_chapter_stats": lambda p, d: totals.chapter_stats(_located(p, d)),
        "g9_text_word_groups": lambda p, d: reports.text_word_groups(_events(p, d)),
        "g10_other_breakdown": lambda p, d: reports.other_breakdown(_events(p, d)),
        "g11_psalm_headings": lambda p, d: reports.psalm_heading_total(_events(p, d)),
        "h1_numeric_chapters": lambda p, d: reports.numeric_chapters(_events(p, d)),
        "h2_text_word_lines": lambda p, d: reports.text_word_lines(_events(p, d)),
        "h3_psalm_heading_lines": lambda p, d: reports.psalm_heading_lines(_events(p, d)),
        "h4_psalm_debug": lambda p, d: reports.psalm_debug(_events(p, d)),
        "i1_comparison": lambda p, d: totals.comparison(_booked(p, d)),
        "i1_comparison_all": lambda p, d: totals.comparison(_booked(p, d), True),
        "i2_unexpected": lambda p, d: totals.unexpected(_mislabelled(p, d)),
        "g_grains": lambda p, d: totals.grains(_located(p, d)),
        "a1_one_document": lambda p, d: _one(p, d).select("lineno", "raw"),
        "c_neighbours_one_document": lambda p, d: machine.events(_one(p, d)).select("lineno", "prev", "next", "prev_raw", "next_raw"),
        "d_events_one_document": lambda p, d: machine.assert_kinds(machine.events(_one(p, d))).select("lineno", "kind", "category", *R.COUNTERS),
        "e_books_one_document": lambda p, d: books.with_book(machine.events(_one(p, d)), blob=True).select("lineno", "book", "blob"),
        "f_chapters_one_document": lambda p, d: _one_located(p, d).select("lineno", "book", "chapter", "chapter_exact"),
        "g8_chapter_stats_one_document": lambda p, d: totals.chapter_stats(_one_located(p, d)),
        "h4_psalm_debug_one_document": lambda p, d: reports.psalm_debug(machine.events(_one(p, d))),
        "j1_psalm_debug_order": lambda p, d: _in_printed_order(printed.psalm_debug_report(_events(p, d))),
        "a3_totals": lambda p, d: printed.totals_report(_events(p, d)),
        "a3_chapter": lambda p, d: printed.chapter_report(_located(p, d), " GENESIS", 1),
        "a3_divisible_by_7": lambda p, d: printed.divisible_report(_located(p, d)),
        "a3_line_samples": lambda p, d: printed.samples_report(_lines(p, d), 2),
        "a3_text_words": lambda p, d: printed.text_words_report(_events(p, d)),
        "a3_psalm_headings": lambda p, d: printed.psalm_headings_report(_events(p, d)),
        "a3_unclassified": lambda p, d: printed.unclassified_report(_lines(p, d), _events(p, d)),
        "a3_comparison": lambda p, d: printed.comparison_report(_mislabelled(p, d)),
        "a3_comparison_all": lambda p, d: printed.comparison_report(_booked(p, d), True),
        "a3_numeric_chapters": lambda p, d: printed.numeric_chapters_report(_events(p, d)),
        "a3_psalm_debug": lambda p, d: printed.psalm_debug_report(_events(p, d)),
    }


# ---- SQL ----
_EDGE = r"(?:[^\p{L}\p{M}\p{Nd}\p{Pc}]|$)"
_TOKEN = R.TOKEN.replace("]*+", "]*").replace(")*+", ")*").replace("++", "+")
# The patterns stand here a second time, in the words of the rules and for another regex engine, so that a slip in the engine's own shows.
_DIGITS, _PSALM, _VERSE = r"^\d+$", r"^PSALM \d+$", r"(?s)^(\d+)[ \t\n\x0B\f\r]+([^ \t\n\x0B\f\r].*)$"
_HEADING = (
    r"(?i)^(To the chief Musician|A Psalm and Song|A (Song and Psalm|Song or Psalm|Psalm or Song)" + _EDGE + r"|A Psalm (for|of) |A Psalm[.]$|(Maschil|Michtam|Shiggaion)" + _EDGE
    + r"|A Prayer of |A Song of |David['’]s Psalm of praise)"
)
_COLOPHON = (
    r"(?i)(^\[(The end|This ends).*\]$|^Or the (foregoing|preceding)|^Written from |^Written to the .|^The .+ written from .+\.$|^Unto the .+ written from" + _EDGE
    + r"|^It was written to .*[^\p{L}\p{M}\p{Nd}\p{Pc}]from" + _EDGE + ")"
)
_TITLE = (
    r"^(THE (FIRST|SECOND|THIRD|FOURTH|FIFTH) BOOK OF MOSES,?|(FIRST|SECOND) BOOK OF [A-Z ]+,?|THE (FIRST|SECOND) BOOK OF THE( [A-Z]+\.)?|BOOK OF THE KINGS[,.]|THE (THIRD|FOURTH) BOOK OF THE KINGS\."
    r"|THE EPISTLE OF PAUL (THE APOSTLE|TO)|EPISTLE OF PAUL THE APOSTLE TO|THE (FIRST|SECOND) EPISTLE GENERAL OF|THE SECOND EPISTLE OF|(THE BOOK OF|OR,) .+\.|PSALM [0-9]+|ST\. [A-Z.]+"
    r"|[A-Z][A-Z \t\n\x0B\f\r,'-]+\.|[A-Z][A-Z \t\n\x0B\f\r,]+;|[A-Z]{3,}\.)$"
)


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(map(_q, xs)) + "]"


def _count(x: str) -> str:
    return f"len(regexp_extract_all({x}, {_q(_TOKEN)}))"


#: the machine as a recursion that takes a line of each document in a step
_STEPS = """st AS (SELECT DISTINCT doc_id, 0::BIGINT AS i, false AS w, false AS e, NULL::VARCHAR AS kind FROM b UNION ALL
  SELECT doc_id, i, CASE kind WHEN 'psalm_119_division' THEN true WHEN 'psalm_title' THEN true WHEN 'verse_after_psalm_heading' THEN false WHEN 'implicit_psalm_opening' THEN NOT clears ELSE w END, kind = 'split_verse_number', kind
  FROM (SELECT b.doc_id, b.i, st.w, b.clears, CASE WHEN st.e THEN 'split_verse_body' WHEN b.stanza THEN 'psalm_119_division' WHEN b.title THEN 'psalm_title' WHEN st.w AND b.heading THEN 'psalm_heading'
    WHEN st.w AND b.verse THEN 'verse_after_psalm_heading' WHEN st.w THEN 'implicit_psalm_opening' WHEN b.pdig AND b.dig THEN 'split_verse_number' ELSE 'numbered_line' END AS kind
    FROM st JOIN b ON b.doc_id = st.doc_id AND b.i = st.i + 1))"""

_KIND = """CASE WHEN a.e THEN 'split_verse_body' WHEN x.ks[1] = 'stanza' THEN 'psalm_119_division' WHEN x.ks[1] = 'title' THEN 'psalm_title' WHEN a.w AND x.ks[1] = 'heading' THEN 'psalm_heading'
    WHEN a.w AND x.ks[1] = 'verse' THEN 'verse_after_psalm_heading' WHEN a.w THEN 'implicit_psalm_opening' WHEN a.d AND x.d THEN 'split_verse_number' ELSE 'numbered_line' END"""
#: the same as a fold: w awaiting, e split, d digits before; a line brings whether it clears (w), its digits (d) and its kind (ks)
_FOLD = f"""lined AS (SELECT doc_id, list({{'w': clears, 'e': false, 'd': dig, 'ks': [CASE WHEN stanza THEN 'stanza' WHEN title THEN 'title' WHEN heading THEN 'heading' WHEN verse THEN 'verse' ELSE 'text' END]}} ORDER BY i) AS ls FROM b GROUP BY doc_id),
folded AS (SELECT doc_id, list_reduce(list_prepend({{'w': false, 'e': false, 'd': false, 'ks': []::VARCHAR[]}}, ls), lambda a, x: {{'w': CASE {_KIND} WHEN 'psalm_119_division' THEN true WHEN 'psalm_title' THEN true
  WHEN 'verse_after_psalm_heading' THEN false WHEN 'implicit_psalm_opening' THEN NOT x.w ELSE a.w END, 'e': {_KIND} = 'split_verse_number', 'd': x.d, 'ks': list_append(a.ks, {_KIND})}}).ks AS ks FROM lined),
st AS (SELECT doc_id, unnest(ks) AS kind, generate_subscripts(ks, 1) AS i FROM folded)"""


def _base(one: bool = False) -> str:
    """one: all lines as one document; its states by a fold over the list of lines, as the recursion would take a step a line."""
    hit = lambda x, p: f"regexp_matches({x}, {_q(p)})"
    pick = lambda xs, i: f"({_list(xs)})[({i}) % {len(xs)} + 1]"
    book = " ".join(f"WHEN stripped = {_q(line)} THEN {_q(b)}" for line, b in R.TRIGGERS.items())
    book += " ".join(f" WHEN stripped = {_q(line)} AND {'prev = ' + _q(part) if near else f'contains(blob, {_q(part)})'} THEN {_q(b)}" for line, near, part, b in R.AMBIGUOUS)
    white = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '"
    return f"""WITH RECURSIVE
t AS (SELECT doc_id, unnest(x) AS t, (generate_subscripts(x, 1) - 1)::BIGINT AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
k AS (SELECT *, {shaped.SHAPE} AS k FROM t),
by_doc AS (SELECT doc_id, pos + 1 AS lineno, CASE WHEN {shaped.MARKS[0]} THEN {_q(R.PSALMS_START)} WHEN {shaped.MARKS[1]} THEN {_q(R.PSALMS_END)} WHEN k <= 1 THEN 'PSALM ' || (pos % 50 + 1) WHEN k = 2 THEN {pick(R.STANZAS, 'doc_id + pos')} WHEN k = 3 THEN {pick(shaped.HEADING_TEXT, 'doc_id + pos')}
  WHEN k <= 6 THEN (pos % 50 + 1)::VARCHAR WHEN k = 7 THEN ' ' || chr(9) || ' ' WHEN k = 8 THEN '0 ' || t WHEN k = 9 THEN '1 ' || t WHEN k <= 15 THEN (pos % 30 + 2) || ' ' || t
  WHEN k = 16 THEN {pick(shaped.TRIGGERS, 'doc_id + pos * 7')} WHEN k = 17 THEN {pick(shaped.BEFORE, 'doc_id + pos')} WHEN k = 18 THEN {pick(shaped.COLOPHON_TEXT, 'doc_id + pos')} ELSE t END AS raw FROM k),
l AS ({'SELECT 0::BIGINT AS doc_id, row_number() OVER (ORDER BY doc_id, lineno) AS lineno, raw FROM by_doc' if one else 'FROM by_doc'}),
s AS (SELECT *, trim(raw, {white}) AS stripped FROM l),
c AS (SELECT *, {hit('stripped', _DIGITS)} AS dig, stripped IN (SELECT unnest({_list(R.STANZAS)})) AS stanza, {hit('stripped', _PSALM)} AS title, {hit('stripped', _VERSE)} AS verse,
  {hit('stripped', _HEADING)} AS heading, regexp_extract(stripped, {_q(_VERSE)}, 1) AS vn, regexp_extract(stripped, {_q(_VERSE)}, 2) AS body FROM s),
classified AS (SELECT *, CASE WHEN stripped = '' THEN 'other' WHEN dig THEN 'chapter' WHEN stanza THEN 'psalm_119_division' WHEN verse THEN 'verse' WHEN heading THEN 'psalm_heading'
  WHEN {hit('stripped', _COLOPHON)} THEN 'colophon' WHEN list_contains({_list(R.TITLE_LINES)}, stripped) OR {hit('stripped', _TITLE)} THEN 'book_title' WHEN {hit('stripped', chr(92) + 'p{L}')} THEN 'unclassified_text' ELSE 'other' END AS category,
  {_count('stripped')} AS tok, {_count('body')} AS body_tok, CASE WHEN verse THEN TRY_CAST(vn AS HUGEINT) END AS num FROM c),
b AS (SELECT *, row_number() OVER w AS i, lag(dig) OVER w AS pdig, lag(raw) OVER w AS prev_raw, lead(raw) OVER w AS next_raw, lag(stripped) OVER w AS prev, lead(stripped) OVER w AS next,
  lead(stripped) OVER w IS NULL OR lead(title) OVER w OR coalesce(lead(num) OVER w >= 2, false) AS clears,
  string_agg(stripped, ' ') OVER (PARTITION BY doc_id ORDER BY lineno ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS blob FROM classified WHERE stripped <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY lineno)),
{_FOLD if one else _STEPS},
d AS (SELECT b.*, st.kind, (st.kind IN ('numbered_line', 'verse_after_psalm_heading')) AS plain FROM b JOIN st USING (doc_id, i)),
ev AS (SELECT *, (CASE WHEN plain AND NOT dig AND NOT verse THEN tok ELSE 0 END)::BIGINT AS text_words,
  (CASE WHEN plain AND verse THEN body_tok WHEN kind = 'split_verse_body' OR kind = 'implicit_psalm_opening' AND clears THEN tok ELSE 0 END)::BIGINT AS verse_text_words,
  (CASE WHEN kind = 'psalm_heading' OR kind = 'implicit_psalm_opening' AND NOT clears THEN tok ELSE 0 END)::BIGINT AS psalm_heading_words, (CASE WHEN kind = 'psalm_119_division' THEN tok ELSE 0 END)::BIGINT AS psalm_119_division_words,
  (kind = 'psalm_title' OR plain AND dig)::BIGINT AS chapter_numbers, (plain AND verse OR kind = 'implicit_psalm_opening' AND clears OR kind = 'split_verse_number')::BIGINT AS verse_numbers,
  (kind = 'psalm_title')::BIGINT AS psalm_chapter_titles, (plain AND dig)::BIGINT AS numeric_chapter_lines, (kind = 'implicit_psalm_opening' AND clears)::BIGINT AS implicit_psalm_verse_1,
  (plain AND verse OR kind = 'split_verse_number')::BIGINT AS numbered_verse_lines FROM d),
bk AS (SELECT *, coalesce(last_value(CASE {book} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY lineno), {_q(R.FRONT)}) AS book FROM ev),
br AS (SELECT *, CASE WHEN book <> lag(book) OVER (PARTITION BY doc_id ORDER BY lineno) THEN 1 ELSE 0 END AS changed FROM bk),
run AS (SELECT *, sum(changed) OVER (PARTITION BY doc_id ORDER BY lineno) AS book_run, CASE WHEN book = 'Psalms' THEN CASE WHEN kind = 'psalm_title' THEN TRY_CAST(stripped[7:] AS BIGINT) END WHEN dig THEN TRY_CAST(stripped AS BIGINT) END AS mark,
  CASE WHEN book = 'Psalms' THEN CASE WHEN kind = 'psalm_title' THEN TRY_CAST(stripped[7:] AS BIGINT) END WHEN plain AND dig THEN TRY_CAST(stripped AS BIGINT) END AS exact_mark FROM br),
loc AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id, book_run ORDER BY lineno) AS chapter, last_value(exact_mark IGNORE NULLS) OVER (PARTITION BY doc_id, book_run ORDER BY lineno) AS chapter_exact FROM run),
canon AS (SELECT * FROM (VALUES {', '.join(f'({i}, {_q(b)}, {c}, {v})' for i, (b, c, v) in enumerate(R.CANON, 1))}) x(ord, book, chapters, verses)),
rng AS (SELECT doc_id, min(lineno) FILTER (stripped = {_q(R.PSALMS_START)}) + 1 AS first, min(lineno) FILTER (stripped = {_q(R.PSALMS_END)}) - 1 AS last FROM classified GROUP BY doc_id HAVING first - 1 < last + 1),
imp AS (SELECT *, coalesce(NOT (stanza OR title OR heading OR dig OR verse) AND next IS NOT NULL AND clears, false) AS looks_implicit FROM ev)
"""


def _printed(part: str, doc_id: str, lineno: str, lines: str, rows: str) -> str:
    """A printed line a row; null lines are left out, their numbers too."""
    return f"SELECT {part} AS part, doc_id, lineno, k, report_line FROM (SELECT ({doc_id})::BIGINT AS doc_id, ({lineno})::BIGINT AS lineno, unnest(x) AS report_line, (generate_subscripts(x, 1) - 1)::INTEGER AS k FROM (SELECT *, [{lines}] AS x FROM {rows})) WHERE report_line IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    sums = ", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in R.COUNTERS)
    comb = " + ".join(R.COMBINED)
    done = f"SELECT *, {comb} AS combined, ({comb}) % 7 = 0 AS divisible_by_7, psalm_chapter_titles + numeric_chapter_lines AS chapters, implicit_psalm_verse_1 + numbered_verse_lines AS verses FROM "
    stats = f"verse_numbers + implicit_psalm_verse_1 AS verse_count, verse_numbers AS verse_count_exact, verse_text_words, {comb} AS combined, ({comb}) % 7 = 0 AS divisible_by_7"
    found = "SELECT book, sum(chapter_numbers)::BIGINT AS chapters, sum(verse_numbers)::BIGINT AS verses FROM bk GROUP BY book"
    one = lambda b, n: f"SELECT {_q(b)} AS book, {n}::BIGINT AS chapter, {stats} FROM (SELECT {sums} FROM loc WHERE book = {_q(b)} AND chapter = {n})"
    compare = "SELECT c.ord::INTEGER AS ord, c.book, coalesce(f.chapters, 0)::BIGINT AS chapters, coalesce(f.verses, 0)::BIGINT AS verses, c.chapters::BIGINT AS exp_chapters, c.verses::BIGINT AS exp_verses FROM"
    bucket = "CASE category WHEN 'book_title' THEN 'book_titles_cover' WHEN 'colophon' THEN 'colophon' ELSE 'other' END"
    counts = {
        "text_words": "CASE WHEN dig OR verse THEN 0 ELSE tok END", "verse_text_words": "CASE WHEN verse THEN body_tok ELSE 0 END", "psalm_heading_words": "0", "psalm_119_division_words": "0",
        "chapter_numbers": "CASE WHEN dig THEN 1 ELSE 0 END", "verse_numbers": "CASE WHEN verse THEN 1 ELSE 0 END",
    }
    shown = "SELECT *, " + ", ".join(f"lead({c}, {k}) OVER (PARTITION BY doc_id ORDER BY lineno) AS {c}_{k}" for k in (1, 2) for c in ("lineno", "stripped", "category", "raw")) + " FROM ev QUALIFY title"
    other = found.replace("SELECT book, ", f"SELECT CASE WHEN doc_id % 10 = 3 THEN {_q(OUTSIDE)} ELSE bk.book END AS book, ").replace("GROUP BY book", "GROUP BY 1")
    divisible = f"SELECT ord, book, chapter, combined FROM (SELECT book, chapter, {stats} FROM (SELECT book, chapter, {sums} FROM loc GROUP BY book, chapter)) JOIN (SELECT ord, book, chapters FROM canon) USING (book) WHERE divisible_by_7 AND chapter BETWEEN 1 AND chapters"
    stray = "SELECT imp.* FROM imp JOIN rng USING (doc_id) WHERE lineno BETWEEN first AND last AND NOT looks_implicit AND category = 'unclassified_text'"
    words = "(SELECT count(*) AS n, coalesce(sum(text_words), 0)::BIGINT AS t FROM ev WHERE text_words > 0)"
    told = "book || ': chapters ' || chapters || ' (expected ' || exp_chapters || '), verses ' || verses || ' (expected ' || exp_verses || ')'"
    totals_lines = ", ".join("''" if not x else "'Debug:'" if x == "Debug" else f"'{x[0]}: ' || {x[1]}" for x in (
        ("Text words", "text_words"), ("Verse text words", "verse_text_words"), ("Psalm heading words", "psalm_heading_words"), ("Psalm 119 division words", "psalm_119_division_words"), ("Chapter numbers", "chapter_numbers"),
        ("Verse numbers", "verse_numbers"), "", "Debug", ("  PSALM chapter titles", "psalm_chapter_titles"), ("  Numeric chapter lines", "numeric_chapter_lines"), ("  Implicit Psalm verse 1", "implicit_psalm_verse_1"),
        ("  Numbered verse lines", "numbered_verse_lines"), "", ("Combined total", "combined"), ("Divisible by 7", "divisible_by_7")))

    def _compared(rows: str, extra: str) -> str:
        return " UNION ALL ".join([
            _printed("0", "ord", "0", told, f"({rows})"), _printed("1", "0", "0", "book || ': chapters ' || chapters || ', verses ' || verses || ' (unexpected book bucket)'", f"({extra})"),
            _printed("3", "0", "0", "'', 'Canonical books: 66', 'Mismatches vs canon: ' || n", f"(SELECT count(*) AS n FROM (SELECT book FROM ({rows}) UNION ALL SELECT book FROM ({extra})))"),
        ])

    heads = "kind = 'psalm_heading' OR kind = 'implicit_psalm_opening' AND psalm_heading_words > 0"
    heading_words = f"(SELECT count(*) AS n, coalesce(sum(psalm_heading_words), 0)::BIGINT AS t FROM ev WHERE {heads})"
    shaped_sql = {
        "b_counts": "SELECT doc_id, " + ", ".join(f"sum({v})::BIGINT AS {k}" for k, v in counts.items()) + " FROM classified GROUP BY doc_id",
        "b_labels": f"SELECT doc_id, x.category AS category, count(*) AS n, min(x.token) AS first_token FROM (SELECT doc_id, unnest(CASE WHEN dig THEN [{{'category': 'chapter_number', 'token': stripped}}] "
        f"WHEN verse THEN list_concat([{{'category': 'verse_number', 'token': vn}}], [{{'category': 'verse_text_word', 'token': y}} FOR y IN regexp_extract_all(body, {_q(_TOKEN)})]) "
        f"ELSE [{{'category': 'text_word', 'token': y}} FOR y IN regexp_extract_all(stripped, {_q(_TOKEN)})] END) AS x FROM classified) GROUP BY ALL",
        "c_classify": "SELECT category, count(*) AS n_lines FROM classified GROUP BY category",
        "c_sample": f"SELECT category, n, doc_id, lineno, stripped FROM (SELECT unnest({_list(R.CATEGORIES)}) AS category) LEFT JOIN (SELECT category, row_number() OVER (PARTITION BY category ORDER BY doc_id, lineno) AS n, doc_id, lineno, stripped FROM classified QUALIFY n <= 3) USING (category)",
        "c_range": "SELECT doc_id, first, last FROM rng",
        "c_implicit": "SELECT doc_id, lineno, stripped FROM imp WHERE looks_implicit",
        "c_unclassified": "SELECT doc_id, lineno, raw, prev, next FROM imp JOIN rng USING (doc_id) WHERE lineno BETWEEN first AND last AND NOT looks_implicit AND category = 'unclassified_text'",
        "c_neighbours": "SELECT doc_id, lineno, prev, next FROM ev",
        "d_events": f"SELECT doc_id, lineno, kind, category, {', '.join(R.COUNTERS)} FROM ev",
        "d_kinds": f"SELECT kind, count(*) AS n, {sums} FROM ev GROUP BY kind",
        "e_books": "SELECT doc_id, lineno, book, coalesce(blob, '') AS blob FROM bk",
        "f_chapters": "SELECT doc_id, lineno, book, chapter, chapter_exact FROM loc",
        "g1_totals": f"{done} (SELECT {sums} FROM ev)",
        "g1_doc_totals": f"{done} (SELECT doc_id, {sums} FROM ev GROUP BY doc_id)",
        "g6_books": found,
        "g7_chapter": one("Genesis", 1),
        "g7_absent_chapter": one("Jude", 99),
        "g8_divisible_by_7": f"SELECT ord::INTEGER AS ord, book, chapter, verse_count, verse_text_words, combined FROM (SELECT book, chapter, {stats} FROM (SELECT book, chapter, {sums} FROM loc GROUP BY book, chapter)) JOIN (SELECT ord, book, chapters FROM canon) USING (book) WHERE divisible_by_7 AND chapter BETWEEN 1 AND chapters",
        "g8_chapter_stats": f"SELECT book, chapter, {stats} FROM (SELECT book, chapter, {sums} FROM loc GROUP BY book, chapter)",
        "g9_text_word_groups": f"SELECT bucket, coalesce(t, 0)::BIGINT AS tokens FROM (SELECT unnest(['book_titles_cover', 'colophon', 'other']) AS bucket) LEFT JOIN (SELECT {bucket} AS bucket, sum(text_words) AS t FROM ev WHERE text_words > 0 GROUP BY 1) USING (bucket)",
        "g10_other_breakdown": "SELECT category AS classification, sum(text_words)::BIGINT AS tokens FROM ev WHERE text_words > 0 AND category NOT IN ('book_title', 'colophon') GROUP BY category",
        "g11_psalm_headings": f"SELECT coalesce(sum(psalm_heading_words), 0)::BIGINT AS tokens, count(*) AS n_lines FROM ev WHERE {heads}",
        "h1_numeric_chapters": "SELECT doc_id, lineno, raw, prev_raw, next_raw FROM ev WHERE numeric_chapter_lines > 0",
        "h2_text_word_lines": "SELECT doc_id, lineno, raw, text_words AS tokens, category AS classification FROM ev WHERE text_words > 0",
        "h3_psalm_heading_lines": f"SELECT doc_id, lineno, raw, kind, psalm_heading_words AS tokens FROM ev WHERE {heads}",
        "h4_psalm_debug": f"SELECT doc_id, lineno, raw, stripped, category, {', '.join(f'{c}_{k}' for k in (1, 2) for c in ('lineno', 'stripped', 'category', 'raw'))} FROM ({shown})",
        "i1_comparison": f"{compare} canon c LEFT JOIN ({found}) f USING (book) WHERE coalesce(f.chapters, 0) <> c.chapters OR coalesce(f.verses, 0) <> c.verses",
        "i1_comparison_all": f"{compare} (SELECT * FROM canon UNION ALL SELECT 0, {_q(R.FRONT)}, NULL, NULL) c LEFT JOIN ({found}) f USING (book)",
        "i2_unexpected": f"SELECT * FROM ({other}) WHERE book <> {_q(R.FRONT)} AND book NOT IN (SELECT book FROM canon)",
        "a3_totals": _printed("0", "0", "0", totals_lines, f"({done} (SELECT {sums} FROM ev))"),
        "a3_chapter": _printed("0", "0", "0", "'Book: ' || book, 'Chapter: ' || chapter, 'Verse count: ' || verse_count, 'Verse text words: ' || verse_text_words, 'Chapter total: ' || combined, 'Divisible by 7: ' || divisible_by_7", f"({one('Genesis', 1)})"),
        "a3_divisible_by_7": _printed("0", "ord", "chapter", "book || chr(9) || chapter || chr(9) || combined", f"({divisible})"),
        "a3_line_samples": f"SELECT 0 AS part, c::BIGINT AS doc_id, 0::BIGINT AS lineno, (generate_subscripts(x, 1) - 1)::INTEGER AS k, unnest(x) AS report_line FROM (SELECT c, ['== ' || category || ' =='] || coalesce(found, ['  (no lines matched in this file)']) || [''] AS x "
        f"FROM (SELECT unnest({_list(R.CATEGORIES)}) AS category, generate_subscripts({_list(R.CATEGORIES)}, 1) AS c) LEFT JOIN (SELECT category, list('  ' || stripped ORDER BY doc_id, lineno) AS found "
        "FROM (SELECT * FROM classified QUALIFY row_number() OVER (PARTITION BY category ORDER BY doc_id, lineno) <= 2) GROUP BY category) USING (category))",
        "a3_text_words": " UNION ALL ".join([
            _printed("0", "0", "0", "'Lines contributing to text_words (' || n || ' lines, ' || t || ' tokens)', ''", words), _printed("1", "doc_id", "lineno", "'L' || lineno || chr(9) || text_words || ' tok' || chr(9) || category, '  ' || raw, ''", "(SELECT * FROM ev WHERE text_words > 0)"),
            _printed("2", "0", "0", "'--- Subtotals (by LineClassifier bucket) ---'", words),
            _printed("3", "i", "0", "b || ': ' || t || ' tokens'", f"(SELECT v.i, b, coalesce(sum(text_words), 0)::BIGINT AS t FROM (VALUES (1, 'book titles / cover', 'book_titles_cover'), (2, 'colophons', 'colophon'), (3, 'other', 'other')) v(i, b, g) LEFT JOIN (SELECT *, {bucket} AS g FROM ev WHERE text_words > 0) USING (g) GROUP BY ALL)"),
            _printed("4", "0", "0", "'', '--- other (by classification) ---'", f"(SELECT 1 WHERE EXISTS (FROM ev WHERE text_words > 0 AND {bucket} = 'other'))"),
            _printed("5", f"list_position(list_sort({_list(R.CATEGORIES)}), category)", "0", "'  ' || category || ': ' || t || ' tokens'", f"(SELECT category, sum(text_words)::BIGINT AS t FROM ev WHERE text_words > 0 AND {bucket} = 'other' GROUP BY category)"),
            _printed("6", "0", "0", "'', 'Total text_words: ' || t", words),
        ]),
        "a3_psalm_headings": " UNION ALL ".join([
            _printed("0", "0", "0", "'Lines contributing to psalm_heading_words (' || n || ' lines)', ''", heading_words), _printed("1", "doc_id", "lineno", "'L' || lineno || chr(9) || psalm_heading_words || ' tok', '  ' || raw, ''", f"(SELECT * FROM ev WHERE {heads})"),
            _printed("2", "0", "0", "'Total psalm_heading_words: ' || t", heading_words),
        ]),
        "a3_unclassified": " UNION ALL ".join([
            _printed("1", "doc_id", "lineno", "'L' || lineno, '  prev: ' || coalesce(prev, '(none)'), '  raw:  ' || raw, '  next: ' || coalesce(next, '(none)'), ''", f"({stray})"),
            _printed("2", "0", "0", "CASE WHEN EXISTS (FROM rng) THEN 'Total: ' || n || ' unclassified_text line(s) in Psalms body' ELSE 'Could not find BOOK OF PSALMS. … THE PROVERBS. span.' END", f"(SELECT count(*) AS n FROM ({stray}))"),
        ]),
        "a3_comparison": _compared(f"{compare} canon c LEFT JOIN ({other}) f USING (book) WHERE coalesce(f.chapters, 0) <> c.chapters OR coalesce(f.verses, 0) <> c.verses", f"SELECT * FROM ({other}) WHERE book <> {_q(R.FRONT)} AND book NOT IN (SELECT book FROM canon)"),
        "a3_comparison_all": " UNION ALL ".join([
            _printed("0", "ord", "0", told, f"({compare} canon c LEFT JOIN ({found}) f USING (book))"),
            _printed("2", "0", "0", "'Front matter: chapters ' || chapters || ', verses ' || verses", f"(SELECT coalesce(max(chapters), 0) AS chapters, coalesce(max(verses), 0) AS verses FROM ({found}) WHERE book = {_q(R.FRONT)})"),
            _printed("3", "0", "0", "'', 'Canonical books: 66', 'Printed all 66 books (+ front matter).'", "(SELECT 1)"),
        ]),
        "a3_numeric_chapters": " UNION ALL ".join([
            _printed("0", "doc_id", "lineno", "'---', 'line ' || lineno || ': ' || raw, '  previous non-empty: ' || coalesce(prev_raw, '(none)'), '  next non-empty: ' || coalesce(next_raw, '(none)')", "(SELECT * FROM ev WHERE numeric_chapter_lines > 0)"),
            _printed("1", "0", "0", "'---', 'Total numeric chapter lines: ' || n", "(SELECT count(*) AS n FROM ev WHERE numeric_chapter_lines > 0)"),
        ]),
        "a3_psalm_debug": _printed("0", "doc_id", "lineno", "'line ' || lineno || ': ' || raw, '  classification: ' || category, " + ", ".join(f"'  next non-empty (line ' || lineno_{k} || '): ' || raw_{k}, '    classification: ' || category_{k}" for k in (1, 2)) + ", ''", f"({shown})"),
    }
    base, of_one = _base(), _base(one=True)
    one_sql = {
        "a1_one_document": "SELECT lineno, raw FROM l", "c_neighbours_one_document": "SELECT lineno, prev, next, prev_raw, next_raw FROM ev", 
        "d_events_one_document": shaped_sql["d_events"].replace("doc_id, lineno", "lineno"), "e_books_one_document": shaped_sql["e_books"].replace("doc_id, lineno", "lineno"),
        "f_chapters_one_document": shaped_sql["f_chapters"].replace("doc_id, lineno", "lineno"), "g8_chapter_stats_one_document": shaped_sql["g8_chapter_stats"], "h4_psalm_debug_one_document": shaped_sql["h4_psalm_debug"],
    }
    return {k: base + v for k, v in shaped_sql.items()} | {k: of_one + v for k, v in one_sql.items()} | {
        "g_grains": base + " UNION ALL BY NAME ".join(f"SELECT '{grain}' AS grain, {'doc_id' if grain == 'document' else 'NULL::BIGINT AS doc_id'}, {'book' if grain in ('book', 'chapter') else 'NULL AS book'}, {'chapter' if grain == 'chapter' else 'NULL::BIGINT AS chapter'}, {sums}, sum({comb})::BIGINT AS combined FROM loc{by}"
            for grain, by in (("all", ""), ("document", " GROUP BY doc_id"), ("book", " GROUP BY book"), ("chapter", " GROUP BY book, chapter"))),
        "j1_psalm_debug_order": base + f"SELECT row_number() OVER (ORDER BY doc_id, lineno, k) AS n, report_line FROM ({shaped_sql['a3_psalm_debug']})",
        "a1_line_scan": "SELECT doc_id, count(*) AS n_lines, sum(len(x))::BIGINT AS n_chars, count(*) AS last_line FROM (SELECT doc_id, unnest(string_split(CASE WHEN suffix(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS x FROM documents) GROUP BY doc_id",
        "b_tokens": f"SELECT doc_id, {_count('text')} AS n_tokens, array_to_string(regexp_extract_all(text, {_q(_TOKEN)})[:5], '|') AS first_tokens FROM documents",
        "b_token_frequencies": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, {_q(_TOKEN)})) AS token FROM documents) GROUP BY token",
    }
