"""The registered queries against their SQL and, stage by stage, the pipeline."""

import pytest
from oracle import duck, duck_side, spark_side

import corpus_pipeline
from utterfold.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    kinds, rows = spark_side(QUERIES[name](spark, FOLDER))
    assert rows
    if name in ORACLES:
        expected_kinds, expected = duck_side(connection, ORACLES[name])
        assert set(kinds) == set(expected_kinds)
        assert rows == expected


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "minhash", "decontamination", "bpe"]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, function in corpus_pipeline.STAGES:
        after = function(spark, docs, FOLDER)
        rows = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert rows <= ids
        if name != "bpe":
            assert after.dtypes == docs.dtypes
            assert len(rows) > 0.7 * len(ids)
        else:
            assert rows == ids
        docs, ids = after, rows
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == ids


def test_contract():
    import __spark_entry__ as contract

    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert set(ORACLES) <= set(contract.oracle_sql())
