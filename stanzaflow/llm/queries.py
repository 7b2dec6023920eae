"""The thin queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontamination, html_text, language_id, near_dedup, nearest, oracles, packing, periodic_runs, quality_rules, resampling, secret_scans, sentence_pieces, sharding
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _digest(packed: DataFrame) -> DataFrame:
    """Packed pieces with the CRC of their ids in the ids' place."""
    crc = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "piece", "start", "length", crc, "sequence_id", "offset")


def op1_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encoded_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(table(spark, sf_dir, "documents"), 3, 85)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), 40).drop("doc")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, added=True)
    return _digest(packed)


def op5_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(periodic_runs.with_loops(table(spark, sf_dir, "documents")), 12))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digest(clustering.cluster(clustering.whole_numbers(table(spark, sf_dir, "embeddings")), 8, 10))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return _digest(corpus_pipeline.run(spark, sf_dir))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_sentence_pieces, op2_near_dedup, op3_sharding, op4_packing, op5_resampling, op6_html_text, op7_nearest, op8_quality_rules, op9_secret_scans, op10_language_id, op11_periodic_runs, op12_decontamination, op13_clustering, pipeline)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
