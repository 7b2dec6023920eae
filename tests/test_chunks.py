"""Lines in chunks against the same lines by document, cut anywhere."""

import itertools

import pytest
from pyspark.sql import functions as F
from test_engine import SAMPLES, sequential

from stanzaflow import cli
from stanzaflow.functions import rules as R
from stanzaflow.operators import books, chunks, machine, reports, totals
from stanzaflow.operators.printed import command_report, comparison_report, in_order, numeric_chapters_report, text_words_report
from stanzaflow.plans import shaped
from stanzaflow.sources import lines as lines_of
from stanzaflow.sources.lines import from_text_files

SF = "/root/testdata/sf0.001"


def test_every_short_sequence_cut_anywhere(spark):
    """Every sequence of up to four kinds of lines, cut at every set of places."""
    cases = [(c, cuts) for n in range(1, 5) for c in itertools.product(SAMPLES, repeat=n) for cuts in itertools.product((0, 1), repeat=n - 1)]
    rows = [(i, list(c), list(itertools.accumulate((0, *cuts)))) for i, (c, cuts) in enumerate(cases)]
    line = F.create_map(*[F.lit(x) for kv in SAMPLES.items() for x in kv])
    lines = spark.createDataFrame(rows, "doc_id long, names array<string>, at array<int>").select("doc_id", "at", F.posexplode("names").alias("pos", "name"))
    lines = lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("lineno"), line[F.col("name")].alias("raw"), F.get("at", "pos").alias("chunk"))
    got = machine.events(lines).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lineno", "kind"))), lambda x: x["kind"]).alias("k")).collect()
    assert len(got) == len(cases)
    assert all(r.k == sequential(cases[r.doc_id][0]) for r in got)


def test_maps_follow_the_rules():
    """Each state and line kind against the sequential reading, from a prefix that leads there."""
    prefix = {0: ["v2"], 1: ["v2", "digits"], 2: ["v2", "digits", "digits"], 3: ["title"], 4: ["title", "digits"]}
    kind = {"stanza": "sets", "title": "sets", "heading": "heading", "v0": "verse", "v1": "verse", "v2": "verse", "digits": "digits", "text": "other"}
    probe = ["digits", "digits", "text", "v1"]  # tells the states apart
    for state, lead in prefix.items():
        for name in SAMPLES:
            for nxt in ("v2", "text", "digits"):
                to = chunks.TURNS[kind[name]][nxt == "v2"][state]
                if state == 4 and name == "v2":
                    continue  # the prefix would end otherwise before it
                tail = [nxt, *probe]
                want = sequential([*lead, name, *tail])[-len(tail):]
                other = "v2" if to == 4 else None  # a digit-only line before a verse would not await
                if other is None or nxt != "v2":
                    assert sequential([*prefix[to], *tail])[-len(tail):] == want, (state, name, nxt)


@pytest.fixture(scope="module")
def one(spark):
    """The shaped corpus as one document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(shaped.shaped_lines(docs).collect(), key=lambda r: (r.doc_id, r.lineno))
    late = lambda i, raw: "Psalms go on" if raw == R.PSALMS_END and i < 0.8 * len(rows) else raw
    return spark.createDataFrame([(7, i, late(i, r.raw)) for i, r in enumerate(rows, 1)], "doc_id long, lineno long, raw string").cache()


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [1, 40, 700])
def test_reports_equal(one, size):
    if size == 40:  # ragged cuts
        cut = one.withColumn("chunk", F.floor(F.col("lineno") / 40) * 1000 + F.when(F.col("lineno") % 40 > F.floor(F.col("lineno") / 40) % 39, 1).otherwise(0))
    else:
        cut = chunks.numbered(one, size)
    whole, parts = machine.events(one), machine.events(cut)
    assert rows_of(parts.drop("chunk", "n", "prior", "follow")) == rows_of(whole)
    booked, there = books.with_book(whole, blob=True), books.with_book(parts, blob=True)
    assert rows_of(there.select("lineno", "book", "blob")) == rows_of(booked.select("lineno", "book", "blob"))
    assert rows_of(books.with_book(parts).select("lineno", "book")) == rows_of(booked.select("lineno", "book"))
    if size == 40:
        at = ["lineno", "book", "chapter", "chapter_exact"]
        assert rows_of(books.with_chapter(books.with_book(parts)).select(at)) == rows_of(books.with_chapter(booked).select(at))
        assert rows_of(reports.psalm_debug(parts)) == rows_of(reports.psalm_debug(whole))
        assert rows_of(reports.psalms_unclassified(parts)) == rows_of(reports.psalms_unclassified(whole)) != []


def test_blank_chunks_between(spark):
    text = ["PSALM 3", *[" "] * 9, "words of it", "", "", "2 two", *["\t"] * 7, "GENESIS.", "1", "", "", "", "2", "", "tail"]
    rows = spark.createDataFrame([(1, i, x, i // 2) for i, x in enumerate(text, 1)], "doc_id long, lineno long, raw string, chunk long")
    whole = machine.events(rows.drop("chunk"))
    parts = machine.events(rows)
    assert rows_of(parts.drop("chunk", "n", "prior", "follow")) == rows_of(whole)
    assert rows_of(books.with_chapter(books.with_book(parts)).select("lineno", "chapter")) == rows_of(books.with_chapter(books.with_book(whole)).select("lineno", "chapter"))
    assert rows_of(reports.psalm_debug(parts)) == rows_of(reports.psalm_debug(whole)) != []


def test_scan_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(chunks, "BLOCK", 3)
    maps = [[0, 2, 1, 4, 3], [1, 1, 1, 1, 1], [2, 3, 4, 0, 1], [4, 3, 2, 1, 0]]
    rows = [(d, c, maps[(c * (d + 2) + c // 3) % 4]) for d in (1, 2) for c in range(20)]
    got = {(r.doc_id, r.chunk): r.entry for r in chunks.entry_states(spark.createDataFrame(rows, "doc_id long, chunk long, turn array<int>")).collect()}
    for d in (1, 2):
        state = 0
        for c in range(20):
            assert got[d, c] == state
            state = rows[[x[:2] for x in rows].index((d, c))][2][state]


def test_lines_stay_by_chunk(one):
    """No exchange of lines by document alone, and no Python."""
    plan = machine.events(chunks.numbered(one, 100)).select("kind")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "SinglePartition" not in plan


@pytest.fixture
def small_ranges(spark):
    key = "spark.sql.files.maxPartitionBytes"
    old, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set(key, old)
    spark.conf.set("spark.sql.files.openCostInBytes", cost)


@pytest.mark.parametrize("files", [
    [b"".join(b"line %d %s\r\n" % (i, b"x" * (i % 90)) for i in range(2_000))], [b"a\n\n\n" * 5_000], [b"", b"one", b"\n", "é\u2028b\rc\n".encode() * 3_000, b"w" * 20_000 + b"\nshort\n" + b"v" * 9_000], [b"no end\n" + b"x" * 100],
])
def test_files_in_byte_ranges(spark, small_ranges, tmp_path, files):
    """Line numbers and texts as a reader of the whole file has them, from many tasks."""
    want = []
    for k, data in enumerate(files):
        (tmp_path / f"{k}.txt").write_bytes(data)
        parts = data.decode().split("\n")
        want += [(k, i, p.removesuffix("\r")) for i, p in enumerate(parts[:-1] if parts[-1] == "" else parts, 1)]
    lines = from_text_files(spark, str(tmp_path))
    names = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("p")).distinct().collect()
    number = {spark.range(1).select(F.xxhash64(F.lit(r.p))).first()[0]: int(r.p.rsplit("/", 1)[1][:-4]) for r in names}
    if "chunk" not in lines.columns:
        assert max(map(len, files)) <= 4096
        lines = lines.withColumn("chunk", F.lit(0))
    got = lines.collect()
    assert sorted((number[r.doc_id], r.lineno, r.raw) for r in got) == want
    if max(map(len, files)) > 12_000:
        assert len({(r.doc_id, r.chunk) for r in got}) > 2
    order = sorted(got, key=lambda r: (r.doc_id, r.lineno))
    assert all(a.chunk <= b.chunk for a, b in zip(order, order[1:]) if a.doc_id == b.doc_id)


def test_reports_of_a_large_file(spark, small_ranges, tmp_path, one):
    """Every command on a file read in many byte ranges against the same lines as one document in a task."""
    rows = [r.raw for r in one.orderBy("lineno").collect()]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(rows) + "\n")
    lines = from_text_files(spark, str(tmp_path / "in" / "a.txt"))
    assert lines.select("chunk").distinct().count() > 20
    whole = one.select(F.lit(lines.first().doc_id).alias("doc_id"), "lineno", "raw")
    for command in (("psalm-debug",), ("text-words-debug",), ("chapters-divisible-by-7",), ("psalms-unclassified-debug",)):
        printed = [r.report_line for r in in_order(command_report(lines, *command)).collect()]
        assert printed == [r.report_line for r in in_order(command_report(whole, *command)).collect()] and printed


def test_written_parts_are_the_report(spark, small_ranges, tmp_path, one):
    report = in_order(numeric_chapters_report(machine.events(one)))
    cli.save(report, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "".join(r.report_line + "\n" for r in report.collect())


def test_text_words_read_the_events_once(spark, one):
    plan = text_words_report(machine.events(one))._jdf.queryExecution().executedPlan().toString()
    events = machine.events(one)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- Window [") == events.count("+- Window [") + events.startswith("Window") and plan.count("Expand") == 1


def test_joined_numbers_lines(spark):
    rows = [(d, i, f"{d}:{i}") for d in (-5, 3, 9, 10, 10**12) for i in (1, 2, 7)]
    got = lines_of.joined(spark.createDataFrame(rows[::-1], "doc_id long, lineno long, raw string"), 4).orderBy("lineno").collect()
    assert [(r.lineno, r.raw, r.chunk) for r in got] == [(k, raw, (k - 1) // 4) for k, (_, _, raw) in enumerate(rows, 1)]
    assert lines_of.joined(spark.createDataFrame([], "doc_id long, lineno long, raw string"), 4).count() == 0


def test_comparison_counts_books_once(one):
    """The printed comparison adds one window, over books, and one join to what books need."""
    booked = books.with_book(machine.events(one))
    plan, base = (d._jdf.queryExecution().executedPlan().toString() for d in (comparison_report(booked), totals.per_book(booked)))
    assert plan.count("Window [") == base.count("Window [") + 1 and plan.count("Join") == 1 and "BroadcastNestedLoopJoin" not in plan


def test_parts_before_a_title_over_lines(spark):
    """A part that spans lines, lines between, the tenth and the eleventh line before; whole and in chunks."""
    title, part, fill = "TIMOTHY.", "SECOND EPISTLE OF PAUL THE APOSTLE TO", "of no use"
    cases = [
        ([part, title], "2 Timothy"), (["SECOND EPISTLE OF", "PAUL THE", "APOSTLE TO", title], "2 Timothy"), (["SECOND EPISTLE OF", fill, "PAUL THE APOSTLE TO", title], R.FRONT),
        ([part, *[fill] * 9, title], "2 Timothy"), ([part, *[fill] * 10, title], R.FRONT), (["", part, " ", *[fill] * 9, "", title], "2 Timothy"), ([title, part], R.FRONT),
        (["x SECOND EPISTLE OF PAUL", "THE APOSTLE TO y", title], "2 Timothy"), (["THE FIRST EPISTLE GENERAL OF", "JOHN.", "PETER."], "1 Peter"),
    ]
    rows = [(d, i, raw) for d, (text, _) in enumerate(cases) for i, raw in enumerate(text, 1)]
    lines = spark.createDataFrame(rows, "doc_id long, lineno long, raw string")
    for given in (lines, chunks.numbered(lines, 1), chunks.numbered(lines, 3)):
        got = books.with_book(machine.events(given)).groupBy("doc_id").agg(F.max_by("book", "lineno").alias("book")).collect()
        assert {r.doc_id: r.book for r in got} == {d: book for d, (_, book) in enumerate(cases)}
