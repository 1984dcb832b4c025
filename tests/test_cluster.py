"""What works in one process but not where executors have their own: run on a small cluster of this machine, in a session of its own."""

import importlib.util
import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from veritab.plans import catalogue
from veritab.plans.sources_sql import TEST_TABLES

SF = "/root/testdata/sf0.001"
NAMES = ["source_jdbc", "source_jdbc_query", "store_database"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
SCRIPT = """
import json, sys
from pyspark.sql import SparkSession, functions as F
from veritab.plans import catalogue
from veritab.sources import readers

at, sf, *names = sys.argv[1:]
options = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "600m", "spark.driver.host": "127.0.0.1", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC",
           "spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{at}/warehouse", "spark.checkpoint.dir": f"file://{at}/shared"}
spark = SparkSession.builder.config(map=options).getOrCreate()
found = {name: [list(r) for r in catalogue.queries()[name](spark, sf).collect()] for name in names}

made = spark.range(0, 25, 1, 3).selectExpr("id", "CASE id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'it''s, \\"so\\"' ELSE concat('x', id) END AS text",
    "CASE WHEN id % 4 > 0 THEN id / 8 END AS x", "CASE WHEN id % 3 > 0 THEN id % 2 = 0 END AS flag", "CASE WHEN id % 7 > 0 THEN timestamp_seconds(id * 3601) END AS at", "decimal(id) / 7 AS d")
readers.write_sql(made, "derby:memory:odd", "odd")
readers.write_sql(made.where("id < 2"), "derby:memory:odd", "odd", "append")
readers.write_sql(made.limit(0), "derby:memory:odd", "nothing", createTableColumnTypes="text VARCHAR(40)")
own = readers.jdbc_options("derby:memory:odd", "odd")
readers._write_in_driver(made.where("id >= 23"), own, 1)
back = readers._read_in_driver(spark, own, 4)
wanted = made.unionAll(made.where("id < 2 or id >= 23"))
found["odd"] = [back.count(), back.exceptAll(wanted).count(), wanted.exceptAll(back).count(), readers.read_sql(spark, "derby:memory:odd", "odd").exceptAll(back).count()]
none = readers.read_sql(spark, "derby:memory:odd", '(SELECT "id", "text" FROM nothing WHERE "id" > 0) AS wanted')
found["none"] = [none.columns, none.count()]
print("FOUND", json.dumps(found))
"""


@pytest.fixture(scope="module")
def found(tmp_path_factory):
    at = tmp_path_factory.mktemp("cluster")
    (at / "home/work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors write below Spark's home
        if p.name != "work":
            (at / "home" / p.name).symlink_to(p)
    repo = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k not in ("PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    env |= {"SPARK_HOME": str(at / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": repo, "PYTHONDONTWRITEBYTECODE": "1", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", SCRIPT, str(at), SF, *NAMES], env=env, cwd=at, capture_output=True, text=True, timeout=600)
    assert "FOUND" in run.stdout, run.stderr[run.stderr.rfind("Traceback") :][:3000]
    return json.loads(run.stdout.rpartition("FOUND")[2])


@pytest.mark.parametrize("name", NAMES)
def test_query_on_a_cluster(found, name):
    duck = duckdb.connect()
    for t in TEST_TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(tuple, found[name])) == sorted(duck.execute(catalogue.oracle_sql()[name]).fetchall())


def test_odd_rows_by_the_driver(found):
    assert found["odd"] == [29, 0, 0, 0] and found["none"] == [["id", "text"], 0]
