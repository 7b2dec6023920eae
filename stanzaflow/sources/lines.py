"""Line sources: text files, document tables, arrays in memory. All give (doc_id, lineno, raw), lineno from 1, blank lines kept.

Where a document may be larger than a task's share, lines also have a `chunk`, ascending with lineno; what reads lines in chunks is in `operators.chunks`.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PIECES = 256

def chomped(line: Column) -> Column:
    return F.regexp_replace(line, r"\r\z", "")


def exploded(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> lines, as a reader that chomps: no line after a final newline, one trailing CR goes."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("lineno"), chomped(F.col("line")).alias("raw"))


def from_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document a file; doc_id is a hash of its path. Line order is a column, never the order of partitions.

    A file is read in byte ranges, each by a task of its own (spark.sql.files.maxPartitionBytes), and each is a chunk. Lines are counted by range, and a running sum
    over the ranges of a file, one row each, gives the number of every range's first line. A range's lines are read in a stretch, so their generated ids ascend by one.
    Where no file is larger than one range, documents fit a task each and lines carry no chunk.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    at = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("chunk"), F.monotonically_increasing_id().alias("at"), "value")
    before = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranges = at.groupBy("path", "chunk").agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    ranges = ranges.select("path", "chunk", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    lines = at.join(ranges, ["path", "chunk"]).select(F.xxhash64("path").alias("doc_id"), (F.col("at") + F.col("shift")).alias("lineno"), chomped(F.col("value")).alias("raw"), "chunk")
    largest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0  # lengths alone are read
    share = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return lines if largest > share else lines.drop("chunk")


def joined(lines: DataFrame, size: int, doc_id: int = 0, dense: bool = False) -> DataFrame:
    """The lines of all documents, in the order of doc_id and lineno, as one document in chunks of `size` line numbers.

    Documents are counted; running sums inside up to PIECES ranges of doc_id and over these ranges give each document the number of its first line.
    dense: each document's lines are numbered 1, 2, ... as exploded; where no doc_id repeats, which the counts tell, lines are then not shuffled to be numbered.
    """
    counts = lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("lineno").alias("last"))
    bounds, once = counts.agg(F.percentile_approx("doc_id", [k / PIECES for k in range(1, PIECES)]), F.every(F.col("lines") == F.col("last"))).first()
    bounds, counts = bounds or [], counts.drop("last")
    piece = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]).cast("array<bigint>"), lambda b: b < F.col("doc_id")))
    inside = Window.partitionBy("piece").orderBy("doc_id")
    counts = counts.withColumn("piece", piece).withColumn("upto", F.sum("lines").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = counts.groupBy("piece").agg(F.max("upto").alias("all"))  # at most PIECES rows
    pieces = pieces.select("piece", F.coalesce(F.sum("all").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    first = counts.join(F.broadcast(pieces), "piece").select(F.col("doc_id").alias("_doc"), (F.col("base") + F.col("upto") - F.col("lines")).alias("_base"))
    order = Window.partitionBy("doc_id").orderBy("lineno")
    placed = lines.withColumn("_n", F.col("lineno") if dense and once else F.row_number().over(order)).join(first, F.col("doc_id") == F.col("_doc"))
    placed = placed.select(F.lit(doc_id).cast("long").alias("doc_id"), (F.col("_base") + F.col("_n")).alias("lineno"), "raw")
    return placed.withColumn("chunk", F.floor((F.col("lineno") - 1) / size))


def from_lines(spark: SparkSession, lines: Iterable[str | None], doc_id: int = 0) -> DataFrame:
    return spark.createDataFrame([(doc_id, i, x) for i, x in enumerate(lines, 1)], "doc_id long, lineno long, raw string")
