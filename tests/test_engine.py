"""Small sequences with known kinds and counters, the state machine against a sequential model, and scalar rules."""

import itertools
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stanzaflow import catalog, cli
from stanzaflow.functions import rules as R
from stanzaflow.functions import text as T
from stanzaflow.operators import books, machine, reports, totals
from stanzaflow.operators.printed import _leading_number
from stanzaflow.sources.lines import exploded, from_lines

#: lines, kinds, the ten counters in order, combined
SEQUENCES = [
    (["58", "1", "CRY aloud, spare not, lift up thy voice like a trumpet."], "numbered_line split_verse_number split_verse_body", (0, 11, 0, 0, 1, 1, 0, 1, 0, 1), 13),
    (["PSALM 10", "WHY standest thou", "2 The wicked"], "psalm_title implicit_psalm_opening numbered_line", (0, 5, 0, 0, 1, 2, 1, 0, 1, 1), 8),
    (["PSALM 119", "ALEPH.", "BLESSED are the undefiled in the way, who walk in the law of the LORD.", "2 Blessed are they"], "psalm_title psalm_119_division implicit_psalm_opening numbered_line", (0, 18, 0, 1, 1, 2, 1, 0, 1, 1), 22),
    (["1", "1 IN the beginning"], "numbered_line numbered_line", (0, 3, 0, 0, 1, 1, 0, 1, 0, 1), 5),
    (["58", "1", "2", "3", "tail words here"], "numbered_line split_verse_number split_verse_body split_verse_number split_verse_body", (0, 4, 0, 0, 1, 2, 0, 1, 0, 2), 7),
    (["58", "1", "PSALM 3", "some words", "2 next verse"], "numbered_line split_verse_number split_verse_body numbered_line numbered_line", (2, 4, 0, 0, 1, 2, 0, 1, 0, 2), 9),
    (["PSALM 7", "Some odd superscription", "1 O LORD my God"], "psalm_title implicit_psalm_opening verse_after_psalm_heading", (0, 4, 3, 0, 1, 1, 1, 0, 0, 1), 9),
    (["PSALM 7", "Plain opener", "0 zero verse", "2 two verse"], "psalm_title implicit_psalm_opening verse_after_psalm_heading numbered_line", (0, 4, 2, 0, 1, 2, 1, 0, 0, 2), 9),
    (["PSALM 117", "Plain opener"], "psalm_title implicit_psalm_opening", (0, 2, 0, 0, 1, 1, 1, 0, 1, 0), 4),
    (["", "PSALM 1", "  ", "Body one", "\t", "2 verse two", ""], "psalm_title implicit_psalm_opening numbered_line", (0, 4, 0, 0, 1, 2, 1, 0, 1, 1), 7),
    (["PSALM 1", "7", "2 verse"], "psalm_title implicit_psalm_opening numbered_line", (0, 2, 0, 0, 1, 2, 1, 0, 1, 1), 5),
    ([None, ""], "", (0,) * 10, 0),
]


def test_sequences(spark):
    lines = None
    for i, (text, *_) in enumerate(SEQUENCES):
        part = from_lines(spark, text, i)
        lines = part if lines is None else lines.union(part)
    events = machine.events(lines)
    kinds = {r.doc_id: r.k for r in events.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "kind"))), lambda x: x["kind"]), " ").alias("k")).collect()}
    sums = {r.doc_id: r for r in totals.per_document(events).collect()}
    for i, (_, kind, counts, combined) in enumerate(SEQUENCES):
        assert kinds.get(i, "") == kind
        if kind:
            assert tuple(sums[i][c] for c in R.COUNTERS) == counts and sums[i].combined == combined
            assert sums[i].chapters == sums[i].chapter_numbers and sums[i].verses == sums[i].verse_numbers
    empty = totals.total(machine.events(from_lines(spark, [None, ""]))).first()
    assert empty.combined == 0 and empty.divisible_by_7


SAMPLES = {"stanza": "ALEPH.", "title": "PSALM 3", "heading": "A Psalm of David.", "v0": "0 zero", "v1": "1 one", "v2": "2 two", "digits": "7", "text": "Plain words"}


def sequential(names):
    """The rules read line by line."""
    wait = split = False
    prev, out = None, []
    for i, n in enumerate(names):
        nxt = names[i + 1] if i + 1 < len(names) else None
        if split:
            kind, split = "split_verse_body", False
        elif n == "stanza":
            kind, wait = "psalm_119_division", True
        elif n == "title":
            kind, wait = "psalm_title", True
        elif wait and n == "heading":
            kind = "psalm_heading"
        elif wait and n[0] == "v":
            kind, wait = "verse_after_psalm_heading", False
        elif wait:
            kind = "implicit_psalm_opening"
            wait = nxt not in (None, "v2", "title")
        elif prev == n == "digits":
            kind, split = "split_verse_number", True
        else:
            kind = "numbered_line"
        prev = n
        out.append(kind)
    return out


def test_every_short_sequence(spark):
    cases = [c for n in range(1, 6) for c in itertools.product(SAMPLES, repeat=n)]
    codes = spark.createDataFrame([(i, list(c)) for i, c in enumerate(cases)], "doc_id long, names array<string>")
    line = F.create_map(*[F.lit(x) for kv in SAMPLES.items() for x in kv])
    lines = codes.select("doc_id", F.posexplode("names").alias("pos", "name")).select("doc_id", (F.col("pos") + 1).cast("long").alias("lineno"), line[F.col("name")].alias("raw"))
    got = machine.events(lines).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "kind"))), lambda x: x["kind"]).alias("k")).collect()
    assert len(got) == len(cases)
    assert all(r.k == sequential(cases[r.doc_id]) for r in got)


def test_one_exchange(spark, capsys):
    events = machine.events(from_lines(spark, ["a", "1"]))
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


@pytest.mark.parametrize("text,want", [
    ("And God said, Let there be light.", "And God said Let there be light"), ("archæology God's well-being", "archæology God's well-being"), ("David’s Psalm of praise.", "David’s Psalm of praise"),
    (None, ""), ("  \n\t ", ""), ("In 1492 Columbus sailed", "In 1492 Columbus sailed"), ("--a x-", "a x"), ("a-" * 10_000, "a" + "-a" * 9_999),
])
def test_tokens(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("w"), T.token_count(F.col("t")).alias("n")).first()
    assert " ".join(r.w) == want and r.n == len(r.w)


def test_categories(spark):
    want = {
        "": "other", "***": "other", "12": "chapter", "ALEPH.": "psalm_119_division", "12 And God": "verse", "To the chief Musician, on Neginoth": "psalm_heading", "Maschilé": "unclassified_text", "maſchil x": "psalm_heading",
        "Written from Rome by Tychicus.": "colophon", "[The end of X]": "colophon", "Unto the Romans written from Corinthus": "colophon", "GENESIS.": "book_title", "PSALM 3": "book_title", "HOLY BIBLE": "book_title",
        "OF": "book_title", "THE BOOK OF DANIEL.": "book_title", "ECCLESIASTES;": "book_title", "BLESSED is the man": "unclassified_text", "GENESIS": "unclassified_text",
    }
    rows = spark.createDataFrame([(k,) for k in want], "s string").select("s", T.category(F.col("s")).alias("c")).collect()
    assert {r.s: r.c for r in rows} == want


def test_all_books_and_chapters(spark):
    lines, want = [], []
    for line, book in R.TRIGGERS.items():
        lines += [line, "1", "1 a b"]
        want.append(book)
    for line, _, before, book in R.AMBIGUOUS:
        lines += ["x"] * 11 + [before, line, "1", "1 a b"]
        want.append(book)
    booked = books.with_book(machine.events(from_lines(spark, lines)))
    started = [r.book_start for r in booked.where("book_start is not null").orderBy("lineno").collect()]
    assert started == want and set(want) == {b for b, _, _ in R.CANON}
    assert totals.unexpected(booked).count() == 0 and totals.comparison(booked).count() > 60 and totals.comparison(booked, True).count() == 67
    psalm = books.with_chapter(books.with_book(machine.events(from_lines(spark, ["BOOK OF PSALMS.", "PSALM 1", "Body one", "2 verse two"]))))
    r = totals.one_chapter(psalm, " psalms ", 1).first()
    assert (r.verse_count, r.verse_count_exact, r.verse_text_words, r.combined, r.divisible_by_7) == (3, 2, 4, 7, True)
    split = books.with_chapter(books.with_book(machine.events(from_lines(spark, ["ISAIAH.", "58", "1", "CRY aloud", "2 two"]))))
    assert [(r.chapter, r.chapter_exact) for r in split.orderBy("lineno").collect()] == [(None, None), (58, 58), (1, 58), (1, 58), (1, 58)]
    with pytest.raises(ValueError):
        totals.one_chapter(psalm, "Genisis", 1)
    with pytest.raises(ValueError):
        totals.one_chapter(psalm, "Genesis", 0)


def test_psalms_reports(spark):
    lines = from_lines(spark, ["BOOK OF PSALMS.", "PSALM 1", "Blessed man", "2 verse two", "Stray line", "PSALM 2", "THE PROVERBS.", "1"])
    events = machine.events(lines)
    assert [(r.first, r.last) for r in reports.psalms_range(lines).collect()] == [(2, 6)]
    assert [r.lineno for r in reports.with_implicit(events).where("looks_implicit").orderBy("lineno").collect()] == [1, 3, 5]
    assert reports.psalms_unclassified(events).count() == 0
    assert reports.psalm_debug(events).count() == 2 and reports.line_samples(lines, 0).count() >= 8
    assert {r.bucket for r in reports.text_word_groups(events).collect()} == {"book_titles_cover", "colophon", "other"}


def test_psalm_stop_is_a_full_stop(spark):
    """The heading `A Psalm.` ends in a full stop, not in any character."""
    want = {"A Psalm.": "psalm_heading", "A Psalms": "unclassified_text", "A Psalm,": "unclassified_text", "a psalm.": "psalm_heading", "A Psalm": "unclassified_text", "A Psalm. x": "unclassified_text"}
    lines = from_lines(spark, want)
    assert {r.stripped: r.category for r in reports.classified(lines).collect()} == want
    events = machine.events(from_lines(spark, ["PSALM 1", "A Psalms", "1 one", "PSALM 2", "A Psalm.", "1 one"]))
    assert [r.kind for r in events.orderBy("lineno").collect()] == "psalm_title implicit_psalm_opening verse_after_psalm_heading psalm_title psalm_heading verse_after_psalm_heading".split()


def test_unclassified_between_marks(spark):
    """Lines between the first marks of their document only, whatever order the documents come in."""
    body = ["Before it", "BOOK OF PSALMS.", "Stray one", "x", "THE PROVERBS.", "After it", "BOOK OF PSALMS.", "Later"]
    lines = from_lines(spark, body, 1).union(from_lines(spark, body[::-1], 2)).union(from_lines(spark, body[:4], 3))
    assert [(r.doc_id, r.lineno) for r in reports.psalms_unclassified(machine.events(lines)).orderBy("doc_id", "lineno").collect()] == [(1, 3), (1, 4), (2, 3)]
    assert [(r.doc_id, r.first, r.last) for r in reports.psalms_range(lines).orderBy("doc_id").collect()] == [(1, 3, 4), (2, 3, 3)]


def test_sources_and_cli(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_bytes("1\r\n1 IN the beginning\n\nend".encode())
    path = str(tmp_path / "a.txt")
    printed = lambda *args: [r.report_line for r in cli.report(spark, path, *args).collect()]
    assert printed() == [
        "Text words: 1", "Verse text words: 3", "Psalm heading words: 0", "Psalm 119 division words: 0", "Chapter numbers: 1", "Verse numbers: 1", "", "Debug:", "  PSALM chapter titles: 0",
        "  Numeric chapter lines: 1", "  Implicit Psalm verse 1: 0", "  Numbered verse lines: 1", "", "Combined total: 6", "Divisible by 7: false",
    ]
    assert printed("text-words-debug") == [
        "Lines contributing to text_words (1 lines, 1 tokens)", "", "L4\t1 tok\tunclassified_text", "  end", "", "--- Subtotals (by LineClassifier bucket) ---", "book titles / cover: 0 tokens", "colophons: 0 tokens",
        "other: 1 tokens", "", "--- other (by classification) ---", "  unclassified_text: 1 tokens", "", "Total text_words: 1",
    ]
    assert printed("numeric-chapters-debug") == ["---", "line 1: 1", "  previous non-empty: (none)", "  next non-empty: 1 IN the beginning", "---", "Total numeric chapter lines: 1"]
    assert printed("psalms-unclassified-debug") == ["Could not find BOOK OF PSALMS. … THE PROVERBS. span."]
    assert printed("psalm-heading-words-debug") == ["Lines contributing to psalm_heading_words (0 lines)", "", "Total psalm_heading_words: 0"]
    assert printed("line-samples", "1")[:8] == ["== chapter ==", "  1", "", "== verse ==", "  1 IN the beginning", "", "== psalm_heading ==", "  (no lines matched in this file)"]
    assert printed("book-stats-debug")[-2:] == ["Canonical books: 66", "Mismatches vs canon: 66"] and len(printed("book-stats-debug")) == 69
    assert printed("book-stats-debug", "--all")[-4:] == ["Front matter: chapters 1, verses 1", "", "Canonical books: 66", "Printed all 66 books (+ front matter)."]
    assert printed("chapter", "Song", "of", "Solomon", "1")[:2] == ["Book: Song of Solomon", "Chapter: 1"] and printed("chapter", "1", "samuel", "3")[0] == "Book: 1 Samuel"
    assert printed("chapters-divisible-by-7") == []
    assert printed("unknown") == printed()  # as without a command
    assert printed("line-samples", "²") == printed("line-samples")
    assert [_leading_number(x) for x in ("2x", " 12 3", "-4", "+5", "x", "²", "", "1_000z", "_1")] == [2, 12, -4, 5, 0, 0, 0, 1000, 0]
    for bad in (("chapter", "Genesis"), ("chapter", "Genesis", "x"), ("chapter", "Genesis", "²"), ("chapter", "No", "Book", "1")):
        with pytest.raises(ValueError):
            cli.report(spark, path, *bad)
    (tmp_path / "p.txt").write_text("PSALM 3\n\n  LORD, how\n2 Many there be")
    cli.write(cli.report(spark, str(tmp_path / "p.txt"), "psalm-debug"))
    assert capsys.readouterr().out.splitlines() == [
        "line 1: PSALM 3", "  classification: book_title", "  next non-empty (line 3):   LORD, how", "    classification: unclassified_text", "  next non-empty (line 4): 2 Many there be", "    classification: verse", "",
    ]
    docs = spark.createDataFrame([(1, "a\n\nb\n"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.lineno, r.raw) for r in exploded(docs).orderBy("doc_id", "lineno").collect()] == [(1, 1, "a"), (1, 2, ""), (1, 3, "b")]


def test_windows_share_one_sort(spark):
    """Books and chapters ride on the partitioning and the order of the events."""
    located = books.with_chapter(books.with_book(machine.events(from_lines(spark, ["a", "1"]))))
    plan = located._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("- Sort [") + plan.count("Sort [") <= 2 and "Python" not in plan


def test_entry_without_llm(spark, tmp_path):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 200
    root = Path(e.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(q) == set(s) and not any(k.startswith('op') for k in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True)
    assert done.returncode == 0 and int(done.stdout) == len(catalog.queries()), done.stderr
