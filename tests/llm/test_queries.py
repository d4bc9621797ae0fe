"""The registered queries and the pipeline on the smallest tables."""

import importlib

import pytest

from oracle import compare, connect
from saltmarsh.llm import catalog, secret_scan

pipeline = importlib.import_module("corpus_pipeline")


@pytest.mark.parametrize("name", list(catalog.BOOK.queries))
def test_query(spark, small, name):
    verdict, rows, _ = compare(spark, connect(small), small, name, catalog.BOOK.queries[name], catalog.BOOK.sql.get(name))
    assert verdict.startswith("ok" if name in catalog.BOOK.sql else "rows-only") and rows > 0, verdict


def test_thirteen_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in catalog.BOOK.queries) == list(range(1, 14))


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, small)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    before, after = seen["toxicity"], seen["near_duplicates"]
    assert after.count() <= before.count() and after.join(before, "doc_id", "left_anti").count() == 0
    assert secret_scan.find_secrets(seen["secrets"]).filter("size(spans) > 0").count() == 0
    assert seen["secrets"].count() == after.count()
    assert seen["mixing"].join(after, "doc_id", "left_anti").count() == 0
    assert seen["packing"].select("doc_id").distinct().count() == seen["mixing"].select("doc_id").distinct().count()


@pytest.mark.parametrize("name", ["odd", "empty"])
def test_stages_on_odd_documents(request, spark, tmp_path, name):
    docs = request.getfixturevalue(name)
    spark.createDataFrame([(1, 0, 0), (2, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for step, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{step}")
        docs = spark.read.parquet(f"{tmp_path}/{step}")
