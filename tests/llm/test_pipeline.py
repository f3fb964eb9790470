"""Stages of the corpus pipeline on clashing names, empty tables and odd rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

DIR = "/root/testdata/sf0.001"
CLASH = ["lang_pred", "score", "bits", "n_words", "n_hit", "items", "hits", "topic", "tokens", "weight", "prob", "sampled", "name", "hash", "n", "id", "__doc_1"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.mark.parametrize("stage", [C.language_id, C.near_dedup, C.decontaminate, C.mix_sources])
def test_columns_of_any_name_stay(spark, docs, stage):
    wide = docs.select("*", *(F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASH))
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, "A plain line of text.", "en", "s", 21), (900002, "A plain line of text.", "en", "s", 21)], docs.schema)
    wide = wide.unionByName(odd.select("*", *(F.lit("mine").alias(c) for c in CLASH)))
    out = stage(spark, wide, DIR)
    assert out.columns == wide.columns and out.schema == wide.schema
    rows = out.collect()
    assert rows and all(r[c] in (f"{c} of {r.doc_id}", "mine") for r in rows for c in CLASH)
    plain = stage(spark, docs.unionByName(odd), DIR).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((r.doc_id or 0, r.text or "") for r in plain)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, none, DIR).count() == 0


def test_odd_rows_by_stage(spark, docs):
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "s", 0), (900002, "A line.", "en", "s", 7), (900002, "A line.", "en", "s", 7)], docs.schema)
    ids = lambda df: sorted(r.doc_id or 0 for r in df.collect() if (r.doc_id or 0) >= 900001 or r.doc_id is None)
    both = docs.unionByName(odd)
    assert ids(C.language_id(spark, both, DIR)) == [900002, 900002]
    assert ids(C.decontaminate(spark, odd, DIR)) == [0, 900001, 900002, 900002]
    assert ids(C.near_dedup(spark, odd, DIR)) in ([900001, 900002],)
    assert C.shard(spark, odd, DIR).count() == 4
