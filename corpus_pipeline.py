"""Corpus pipeline: documents -> quality rules -> language ID -> near-dedup -> secret masking -> packed sequences.

Each stage takes (spark, docs, sf_dir) and its decisions take effect on what its predecessor kept; `run` writes each
stage as Parquet in the shared folder and reads it again for the next one; `write` also writes the result and leaves nothing else there.

Cases: rows with a null or empty text, or with fewer than 50 words, fail the first stage; null lang or source form groups of their own there.
Repeated rows and exact or near copies leave one row. Rows with a null doc_id are judged on their texts like any other and their pieces carry a null doc_id.
Of tied copies the least doc_id stays, a null one last, then the first row. An empty table gives no rows. Extra columns, whatever their names, go with
their rows up to the last stage, which returns pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stanzaflow.llm import language_id, near_dedup, packing, quality_rules, secret_scans
from stanzaflow.llm.common import removed, scratch, stored_at, table

TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents outside the fences of their language and source go."""
    return quality_rules.quality_filter(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents without a language, or told with a probability under one half, go."""
    return language_id.language_filter(docs, 0.5)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2 on five-word shingles at 0.8: the smallest doc_id of each group stays."""
    return near_dedup.deduplicated(docs, 5, 80)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: found secrets are masked in the text; every document stays."""
    return secret_scans.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: every document, tokenized, in sequences of at most 2048 tokens; each piece with its ids (`packing.sequences` joins them)."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), added=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL expresses neither a trained network nor MinHash groups; tests/llm compares the rows with the stages worked by hand, the predictor aside.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces. A stage's folder goes when the next stage is written; the last one's stays for the rows returned, unless a `scratch` scope is open around."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own intermediates go when its rows are written
            docs, path = stored_at(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


def write(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Writes the pieces to path; no folder of a stage stays."""
    with scratch(spark):
        run(spark, sf_dir).write.parquet(path)
