"""Command line: one text file, one report, printed line by line or written in parts.

    python -m stanzaflow.cli [--out FOLDER] FILE [chapter BOOK NAME N | chapters-divisible-by-7 | line-samples [N] | text-words-debug | psalm-heading-words-debug |
                                   psalms-unclassified-debug | book-stats-debug [--all] | numeric-chapters-debug | psalm-debug]
"""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession

from .operators.printed import command_report, in_order
from .sources.lines import from_text_files


def report(spark: SparkSession, path: str, command: str = "totals", *args: str) -> DataFrame:
    """The printed lines of one command, in order; raises ValueError for what the command line cannot mean."""
    return in_order(command_report(from_text_files(spark, path), command, *args))


def write(rows: DataFrame, out: TextIO | None = None) -> None:
    for row in rows.select("report_line").toLocalIterator():
        print(row[0], file=out or sys.stdout)


def save(rows: DataFrame, folder: str) -> None:
    """The report as text files, each written by a task of its own; joined in the order of their names they are the report."""
    rows.select("report_line").write.text(folder)


def main(argv: list[str]) -> int:
    folder = argv[1] if argv[:1] == ["--out"] and len(argv) > 2 else None
    argv = argv[2:] if folder else argv
    if not argv or argv[0] == "--out":
        print(__doc__, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("stanzaflow").getOrCreate()
    try:
        rows = report(spark, *argv)
        save(rows, folder) if folder else write(rows)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
