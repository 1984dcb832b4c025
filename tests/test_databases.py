"""Queries over a database of the driver's process, with odd tables: by tasks in local mode, and by the driver, as on a cluster."""

from pathlib import Path

import duckdb
import pytest

from veritab.plans import catalogue, entries_more, lineage

ROWS = {
    "nation": "SELECT i::INTEGER AS n_nationkey, CASE i % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE repeat('äx', 20000) END AS n_name, CASE WHEN i % 7 > 0 THEN (i % 5)::INTEGER END AS n_regionkey FROM range({n}) r(i)",
    "supplier": "SELECT i AS s_suppkey, CASE i % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE repeat('äx', 20000) END AS s_name, 1 AS s_nationkey, CASE WHEN i % 4 > 0 THEN i % 5 - 2.5::DOUBLE END AS s_acctbal FROM range({n}) r(i)",
}


@pytest.mark.parametrize("n", [0, 60])
@pytest.mark.parametrize("by_driver", [False, True])
@pytest.mark.parametrize(("name", "table"), [("source_jdbc_query", "nation"), ("source_jdbc", "supplier")])
def test_odd_table_through_a_database(spark, tmp_path, monkeypatch, name, table, by_driver, n):
    duck = duckdb.connect()
    duck.execute(f"COPY ({ROWS[table].format(n=n)}) TO '{tmp_path}/{table}.parquet'")
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    if by_driver:
        lineage.folder(spark)  # the shared folder of local mode, before this counts as a cluster
        monkeypatch.setattr(lineage, "in_one_process", lambda spark: False)
    found = [tuple(r) for r in catalogue.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(duck.execute(catalogue.oracle_sql()[name]).fetchall(), key=repr)


def test_database_is_kept_in_files(spark, tmp_path):
    """In memory, a table of 25 million rows was more than a driver of 750 MB holds."""
    duckdb.execute(f"COPY ({ROWS['nation'].format(n=9)}) TO '{tmp_path}/nation.parquet'")
    uri = entries_more._database(catalogue.Tables(spark, str(tmp_path)), "nation", "n_regionkey")
    assert list(Path(uri.removeprefix("derby:")).glob("seg0/*.dat"))


def test_texts_of_a_database_are_compared_by_spark(spark, tmp_path):
    duckdb.execute(f"COPY ({ROWS['supplier'].format(n=60)}) TO '{tmp_path}/supplier.parquet'")
    found = catalogue.queries()["source_jdbc"](spark, str(tmp_path)).where("s_name = ''").count()
    wanted = duckdb.sql(f"SELECT * FROM '{tmp_path}/supplier.parquet' WHERE s_acctbal > 0 AND s_name = ''").fetchall()
    assert found == len(wanted) > 0
