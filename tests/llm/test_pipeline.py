"""Every stage and the whole pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import stages
from panelcast.llm.catalog import ORACLES, QUERIES

from odd_rows import SF, collected

SF01 = "/root/testdata/sf0.01"


def test_names_and_order():
    assert sorted({int(k.split("_")[0][2:]) for k in QUERIES}) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.toxicity, stages.simhash, stages.secrets, stages.mixing, stages.packing]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_on_odd_rows(spark, odd_docs, no_docs, stage):
    out = stage(spark, odd_docs, SF)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    assert out.count() > 0
    assert stage(spark, no_docs, SF).count() == 0


def test_packing_stage_on_odd_rows(spark, odd_docs, no_docs):
    assert stages.packing(spark, odd_docs, SF).select("doc_id").distinct().count() == 10
    assert stages.packing(spark, no_docs, SF).count() == 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_columns_named_like_helpers_pass(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["__score", "__row", "__key", "__id", "__hash", "__text", "__dup", "__n", "__copies", "__copy", "__KEY_"]
    docs = docs.union(docs.limit(5)).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    for c in names:
        docs = docs.withColumn(c, F.col("doc_id"))
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == r["doc_id"] for r in rows for c in names)


def test_dedup_keeps_one_of_each_group(spark, odd_docs):
    from panelcast.llm.simhash import simhash_dedup

    groups = simhash_dedup(odd_docs).select("root").distinct().count()
    kept = collected(stages.simhash(spark, odd_docs, SF))
    assert len(kept) == groups
    assert {r["doc_id"] for r in kept} >= {1, 4} and not {2, 3, 5} & {r["doc_id"] for r in kept}


def test_mixing_repeats_documents(spark):
    from panelcast.llm.mixing import mix

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    copies = {r["id"]: r["copies"] for r in mix(docs).collect() if r["copies"]}
    out = {r["doc_id"]: r["count"] for r in stages.mixing(spark, docs, SF01).groupBy("doc_id").count().collect()}
    assert out == copies


def test_secrets_are_gone_and_clean_documents_unchanged(spark):
    from panelcast.llm.secrets import base_spans

    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r for r in stages.secrets(spark, docs, SF01).collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        if base_spans(text):
            assert not base_spans(after[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"])
        elif "[SECRET]" not in after[i]["text"]:
            assert after[i]["text"] == text


def test_run_equals_its_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, out.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))
    assert out.where(F.col("offset") + F.col("length") > 2048).isEmpty()
