"""Registered queries of the subpackage and the pipeline on given tables."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from check_oracle import compare, connect
from surety.llm.oracles import ORACLES
from surety.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_over_the_whole_table(spark, name):
    df = QUERIES[name](spark, FOLDER)
    table = "embeddings" if name.startswith(("op4", "op11")) else "pages" if name.startswith("op5") else "documents"
    n = spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    if name.startswith(("op3", "op5", "op6", "op7", "op13")):
        assert df.count() == n
    elif name.startswith("op4"):
        assert df.count() == 10 * -(-n // 100)
    elif name.startswith("op11"):
        assert df.count() == 8 * n
    elif name.startswith("op1_"):
        assert df.select("doc_id").distinct().count() == n
    else:
        assert 0 < df.select("doc_id").distinct().count() < n


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, FOLDER)
        assert out.columns == columns, name
        assert out.exceptAll(out.dropDuplicates(["doc_id"])).count() == 0
        seen = out
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, FOLDER)
    assert packed.select("doc_id").distinct().count() == seen.count()


def test_pipeline_takes_an_empty_table(spark):
    seen = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        seen = stage(spark, seen, FOLDER)
        assert seen.count() == 0
