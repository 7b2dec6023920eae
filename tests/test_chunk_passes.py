"""What lines in chunks keep of others, and how dense lines are numbered."""

import pytest
from pyspark.sql import functions as F

from stanzaflow.operators import chunks, machine
from stanzaflow.plans import shaped
from stanzaflow.sources import lines as lines_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return shaped.shaped_lines(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).cache()


def test_only_ends_of_chunks_keep_lines_of_others(lines):
    e = machine.events(lines_of.joined(lines, 100)).select("n", "chunk", "prior", "follow", F.count("*").over(chunks.by_chunk().partitionBy("doc_id", "chunk").rowsBetween(-10**9, 10**9)).alias("of"))
    assert e.where("prior is not null and n > 10 or follow is not null and n <= of - 2").count() == 0
    assert e.where("size(prior) > 0").count() and e.where("size(follow) > 0").count()


def test_dense_lines_are_numbered_without_a_shuffle_by_document(spark, lines):
    plain, dense = (lines_of.joined(lines, 100, dense=d) for d in (False, True))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dense.collect()))
    assert dense._jdf.queryExecution().optimizedPlan().toString().count("row_number") == 0
    twice = spark.createDataFrame([(d, i, f"{d}:{i}") for d in (3, 5, 5) for i in (1, 2)], "doc_id long, lineno long, raw string")  # a doc_id that repeats
    assert sorted(r.lineno for r in lines_of.joined(twice, 4, dense=True).collect()) == [1, 2, 3, 4, 5, 6]
