"""The registered queries on the smallest tables, and the pipeline's stages."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docaudit.llm.queries import ORACLES, QUERIES

from ..oracle_check import compare, connect
from .helpers import documents, rows

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, QUERIES[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_returns_every_document(spark, name):
    if name == "op11_whitening":  # a row for each vector and component
        out = QUERIES[name](spark, SF_DIR)
        assert out.count() == 16 * spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
        return
    out = QUERIES[name](spark, SF_DIR)
    assert out.select("doc_id").distinct().count() == out.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, SF_DIR)
        assert out.columns == docs.columns, name
        if name != "mix":
            assert 0.5 * at.count() < out.count() <= at.count(), name
        at = corpus_pipeline.written(out, f"test-{name}")
    last = corpus_pipeline.STAGES[-1][1](spark, at, SF_DIR)
    assert last.count() == at.count() > 0
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF_DIR).select("doc_id").collect()) == sorted(r["doc_id"] for r in last.select("doc_id").collect())


CLASH = {"_drop": 1, "_text": "t", "_hash": 2, "_source": "s", "_name": "n", "n_lines": 77, "_lang": "l", "row": 3, "kept": 4, "copies": 5}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_foreign_columns(spark, name):
    stage, clash = dict(corpus_pipeline.STAGES)[name], CLASH
    docs = documents(spark).withColumns({k: F.lit(v) for k, v in clash.items()})
    docs = docs.unionByName(docs.filter("doc_id < 3"))
    out = stage(spark, docs, SF_DIR)
    kept = [c for c in out.columns if c not in ("token_ids", "n_tokens")]
    assert kept == docs.columns
    found = out.collect()
    assert found and all({k: r[k] for k in clash} == clash for r in found)
    ids = {r["doc_id"] for r in found}
    assert ids <= {r[0] for r in rows()} and len(ids) > 0.5 * len(rows())
    if name == "tokenize":
        assert len(found) == docs.count()
    assert stage(spark, docs.limit(0), SF_DIR).collect() == []
