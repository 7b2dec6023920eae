"""The shaped corpus: documents' lines given the forms the engine reads, by integer arithmetic on doc_id and position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R

HEADING_TEXT = ("A Psalm of David.", "To the chief Musician, on Neginoth", "Maschil of Asaph")
COLOPHON_TEXT = ("Written from Rome by Tychicus.", "[The end of the epistle]", "It was written to them from Corinthus")
TRIGGERS = (*R.TRIGGERS, *dict.fromkeys(a[0] for a in R.AMBIGUOUS))
BEFORE = ("THE FIRST BOOK OF THE", "THE SECOND BOOK OF THE", "FIRST EPISTLE OF PAUL THE APOSTLE TO", "SECOND EPISTLE OF PAUL THE APOSTLE TO", "THE FIRST EPISTLE GENERAL OF", "THE SECOND EPISTLE GENERAL OF", "THE SECOND EPISTLE OF", "THE THIRD EPISTLE OF")
#: positions of the first document lines that mark where Psalms begin and end: in one document of four in that order, in one of twelve the other way round
MARKS = ("doc_id % 4 = 0 AND pos = 0 OR doc_id % 12 = 1 AND pos = 5", "doc_id % 4 = 0 AND pos = 5 OR doc_id % 12 = 1 AND pos = 0")
SHAPE = "((doc_id * 7919 + pos * 104729) % 10007 * 31 + pos * pos * 17) % 24"


def shaped_lines(docs: DataFrame) -> DataFrame:
    d, p = F.col("doc_id"), F.col("pos")
    t = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).withColumn("pos", p.cast("long")).withColumn("k", F.expr(SHAPE))
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    k, n = F.col("k"), (p % 50 + 1).cast("string")
    cases = [
        (F.expr(MARKS[0]), F.lit(R.PSALMS_START)), (F.expr(MARKS[1]), F.lit(R.PSALMS_END)),
        (k <= 1, F.concat(F.lit("PSALM "), n)), (k == 2, pick(R.STANZAS, d + p)), (k == 3, pick(HEADING_TEXT, d + p)), (k <= 6, n), (k == 7, F.lit(" \t ")),
        (k == 8, F.concat(F.lit("0 "), "t")), (k == 9, F.concat(F.lit("1 "), "t")), (k <= 15, F.concat((p % 30 + 2).cast("string"), F.lit(" "), F.col("t"))),
        (k == 16, pick(TRIGGERS, d + p * 7)), (k == 17, pick(BEFORE, d + p)), (k == 18, pick(COLOPHON_TEXT, d + p)),
    ]
    raw = reduce(lambda acc, c: acc.when(*c), cases, F.when(F.lit(False), "")).otherwise(F.col("t"))
    return t.select("doc_id", (p + 1).alias("lineno"), raw.alias("raw"))
