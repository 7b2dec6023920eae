"""Shared pieces of the training-data operators: table access and durable intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule `[^\x20\x09-\x0D]+`.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local master, which has one machine, gets one of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} it has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="stanzaflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what `stored` wrote inside without `keep`; what is kept belongs to the scope around it."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored_at(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing. Also returns the place, for `removed`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    for scope in _scopes[: len(_scopes) - keep][-1:]:
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    return stored_at(df, name, keep)[0]


def words(text: Column) -> Column:
    """Array of the words `[^\\x20\\x09-\\x0D]+` of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def wide(spark: SparkSession) -> int:
    """Partitions for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(batches, rows: int = 256):
    """Arrow batches cut into slices, so that few texts exist as Python objects at a time."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal keys, each inside one batch, with these keys."""
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for s, e in zip([0, *new], [*new, b.num_rows]):
            yield tuple(c[s] for c in cols), b.slice(s, e - s)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, across batches; rows come sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for now, part in runs(batches, keys):
        if held and now != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(part)
        last = now
    if held:
        yield pa.Table.from_batches(held)


def vocabulary(path: str) -> str:
    """A vocabulary file's place on this machine: path itself, or where the executor's own package of vocabularies has that file."""
    import os

    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))
