"""The pipeline's stages and the registered queries."""

import importlib

import pytest

import __spark_entry__
import corpus_pipeline
from seqlens.llm.common import without_ids


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    corpus.write.parquet(f"{base}/documents.parquet")
    item = corpus.where("doc_id = 3").first().text
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        rows = docs.collect()
        sizes.append(len(rows))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "decontamination":
            assert 3 not in {r.doc_id for r in rows}
    assert sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[5] == sizes[4]


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and found.count() > 0


def test_without_ids_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "c", 7)], "doc_id long, kept string, component_id int")
    kept = without_ids(docs, spark.createDataFrame([(2,), (None,)], "doc_id long"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None}


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert importlib.import_module("seqlens.llm.registry").oracle_sql().keys() <= set(names)
