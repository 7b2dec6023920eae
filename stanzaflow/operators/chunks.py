"""Documents too large for one task: lines that carry a `chunk` number, ascending with lineno inside a document, are read chunk by chunk.

What a chunk has to know of the others travels as one row a chunk: its first and last non-blank lines, and the map from each state in which the reader may
enter it to the state in which it leaves. Maps compose, so a scan over the rows of a document gives every chunk its entry state; windows over them give it
the lines before and after, however many chunks (blank ones too) lie between. Lines themselves are partitioned by (doc_id, chunk) and never gathered by
document. The rows of chunks come from the lines by a second pass, which evaluates only the facts that states depend on. doc_id is not null.

States of the reader between two lines: 0 nothing pending, 1 after a digit-only line, 2 after a verse number split from its body, 3 awaiting a psalm's
first verse, 4 awaiting it after a digit-only line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import text as T

SIZE, BLOCK, AHEAD, BEHIND = 100_000, 512, 2, 10
KEYS = ("doc_id", "chunk")
#: where a line leads from each state; of lines whose effect depends on it, with a next line that opens a verse or psalm second
TURNS = {
    "digits": ((1, 2, 1, 4, 4), (1, 2, 1, 1, 1)), "sets": ((3, 3, 0, 3, 3),) * 2, "heading": ((0, 0, 0, 3, 3),) * 2, "verse": ((0, 0, 0, 0, 0),) * 2, "other": ((0, 0, 0, 3, 3), (0, 0, 0, 0, 0)),
}
_ROWS = [row for pair in TURNS.values() for row in pair]


def numbered(lines: DataFrame, size: int = SIZE) -> DataFrame:
    """Chunks of `size` line numbers."""
    return lines.withColumn("chunk", F.floor((F.col("lineno") - 1) / size))


def _same() -> Column:
    return F.array(*[F.lit(s) for s in range(5)])


def _then(first: Column, second: Column) -> Column:
    """The map that does one after the other."""
    return F.transform(first, lambda s: F.element_at(second, s + 1))


def _turn(kind: Column, opens: Column) -> Column:
    table = F.array(*[F.array(*[F.lit(s) for s in row]) for row in _ROWS])
    return F.element_at(table, 2 * kind + F.when(opens, 2).otherwise(1))


def _kind() -> Column:
    """Number of the line's kind in TURNS."""
    return F.when(F.col("digits"), 0).when(F.col("stanza") | F.col("title"), 1).when(F.col("heading"), 2).when(F.col("verse"), 3).otherwise(4)


def by_chunk() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("chunk")


def _entered(folded: Column) -> Column:
    """The states in which a list of maps is entered one after the other, from a given first state: (state, maps) -> states."""
    none = F.array().cast("array<int>")
    start = F.struct(folded["state"].alias("s"), none.alias("out"))
    step = lambda acc, m: F.struct(F.element_at(m, acc["s"] + 1).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    return F.aggregate(folded["maps"], start, step, lambda acc: acc["out"])


def entry_states(maps: DataFrame) -> DataFrame:
    """(doc_id, chunk, turn, ...) -> the same with entry: a scan in two levels, over blocks of BLOCK chunks and inside each. The rows pass once, with what they carry."""
    row = F.struct("chunk", *[c for c in maps.columns if c not in KEYS])
    blocks = maps.withColumn("block", F.floor((F.row_number().over(by_chunk()) - 1) / BLOCK)).groupBy("doc_id", "block").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    blocks = blocks.withColumn("whole", F.aggregate(F.col("rows")["turn"], _same(), _then))
    before = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("state", F.element_at(F.aggregate(F.collect_list("whole").over(before), _same(), _then), 1))
    inside = _entered(F.struct(F.col("state"), F.col("rows")["turn"].alias("maps")))
    return blocks.select("doc_id", F.explode(F.arrays_zip(F.col("rows"), inside.alias("entry"))).alias("x")).select("doc_id", "x.rows.*", "x.entry")


def summaries(features: DataFrame) -> DataFrame:
    """One row for each chunk with a non-blank line: entry (state), prior (up to BEHIND lines before it, in their order) and follow (up to AHEAD lines after it)."""
    inside = Window.partitionBy(*KEYS)
    w = inside.orderBy("lineno")
    f = features.withColumns({"kind": _kind(), "of": F.count("*").over(inside), "opens": F.lead("opens_next").over(w)})
    sure = F.max(F.when((F.col("kind") == 3) | ((F.col("kind") == 4) & F.col("opens")), F.col("n"))).over(inside)  # what comes before a line that leads to one state does not matter
    f = f.withColumn("sure", F.coalesce(sure, F.lit(1)))
    line = F.struct("n", "lineno", "raw", "opens_next", (F.col("stanza") | F.col("title")).alias("sets"))
    gather = lambda when, what: F.array_sort(F.collect_list(F.when(when, what)))
    # at most AHEAD and BEHIND lines, and the kinds after the last sure line
    s = f.groupBy(*KEYS).agg(
        gather(F.col("n") <= AHEAD, line).alias("head"), gather(F.col("n") > F.col("of") - BEHIND, F.struct("n", "raw")).alias("tail"), F.max_by("kind", "n").alias("last"),
        gather((F.col("n") >= F.col("sure")) & (F.col("n") < F.col("of")), F.struct("n", "kind", "opens")).alias("turns"),
    )
    lines = lambda c, a, b: F.flatten(F.collect_list(c).over(by_chunk().rowsBetween(a, b)))
    s = s.withColumns({"prior": lines("tail", -BEHIND, -1), "follow": F.slice(lines("head", 1, AHEAD), 1, AHEAD)})
    s = s.withColumn("prior", F.slice("prior", F.greatest(F.lit(1), F.size("prior") - BEHIND + 1), BEHIND))
    turn = F.aggregate("turns", _same(), lambda m, x: _then(m, _turn(x["kind"], x["opens"])))
    opens = F.coalesce(F.get("follow", F.lit(0))["opens_next"], F.lit(True))
    s = s.withColumn("turn", _then(turn, _turn(F.col("last"), opens))).select(*KEYS, "prior", "follow", "turn")
    return entry_states(s).drop("turn")


def carried(rows: DataFrame, of_chunk: dict[str, Column], over_chunks: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """Adds columns worked out over the chunks of a document: `of_chunk` are aggregates of a chunk's rows, `over_chunks` windows over those."""
    s = rows.groupBy(*KEYS).agg(*[c.alias(k) for k, c in of_chunk.items()])
    s = s.select(*KEYS, *[f(by_chunk()).alias(k) for k, f in over_chunks.items()])
    return rows.join(s, list(KEYS))


def latest(c: Column) -> Column:
    """The last non-null value in a chunk."""
    return F.max_by(c, F.when(c.isNotNull(), F.col("lineno")))


def earlier(name: str) -> Callable[[WindowSpec], Column]:
    """The last non-null value of the chunks before."""
    return lambda w: F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))


def anywhere(name: str) -> Callable[[WindowSpec], Column]:
    """The least value in the document."""
    return lambda w: F.min(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def stripped(line: Column) -> Column:
    """Of a line carried from another chunk; null where there is none."""
    return F.when(line["raw"].isNotNull(), T.strip(line["raw"]))


def following(k: int, have: list[Column], follow: Column, name: str) -> Column:
    """The k-th line after a line: one of its chunk (`have`: what lead gives for 1, 2, ...), else one of the lines after the chunk."""
    left = sum((F.when(h.isNotNull(), 1).otherwise(0) for h in have), F.lit(0))
    line = F.get(follow, F.lit(k - 1) - left)
    return T.category(stripped(line)) if name == "category" else stripped(line) if name == "stripped" else line[name]
