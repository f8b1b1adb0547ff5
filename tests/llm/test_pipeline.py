"""The registered queries and the pipeline on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_all_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11))


def test_fingerprints_are_native(spark):
    plan = entry.queries()["op10_fingerprints"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert sorted(out.dtypes) == sorted(docs.dtypes)
        docs = out.cache()
        counts.append(docs.count())
    bad = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").collect()}
    assert counts[0] > counts[1] > counts[2] == counts[3]
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(kept & bad) <= 0.25 * len(bad)  # a handful of labelled rows
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept
    nothing = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        nothing_left = stage(spark, nothing, FOLDER)
        assert nothing_left.count() == 0
