"""The registered queries against their SQL, and the pipeline stage by stage, over the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from veritab.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, SF)
    sql = queries.oracle_sql().get(name)
    if not sql:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    plain = lambda r: tuple(None if v is None else str(v).lower() for v in r)
    assert sorted(map(plain, got.select(*names).collect()), key=str) == sorted(map(plain, want.fetchall()), key=str)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and 0 < out.count() <= before
            before, docs = out.count(), out
    assert out.select("doc_id").distinct().count() == before
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
