"""Readers, stores, and the same windows over a stream as over a batch."""

import datetime as dt

import pyarrow as pa
from pyspark.sql import functions as F

from veritab.operators import completeness
from veritab.sources import readers
from veritab.streaming import windows


def test_arrow_files(spark, tmp_path):
    table = pa.table({"a": [1, 2, 3], "s": ["x", None, "z"]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, table.schema) as w:
        w.write_table(table, max_chunksize=2)
    df = readers.read_file(spark, str(tmp_path / "t.arrow"))
    assert sorted(r.a for r in df.collect()) == [1, 2, 3] and df.rdd.getNumPartitions() == 2


def test_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 5}')
    assert readers.read_file(spark, str(tmp_path / "one.json")).first().a == 5
    df = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), (None,), ("no",)], "j string")
    assert [tuple(r) for r in readers.decode_json(df, "j", "a int, b struct<c: string>").select("a", "b.c").collect()][0] == (1, "x")
    nested = spark.createDataFrame([(1, (2, "x"))], "a int, b struct<c: int, d: string>")
    assert readers.flatten(nested).columns == ["a", "b.c", "b.d"]


def test_jdbc_options():
    got = readers.jdbc_options("postgresql://u:p@h/db", "t")
    assert got["url"] == "jdbc:postgresql://h:5432/db" and got["user"] == "u" and got["dbtable"] == "t"
    assert readers.jdbc_options("mssql://h/db", query="select 1")["url"] == "jdbc:sqlserver://h:1433;databaseName=db"


def test_stores(spark, tmp_path):
    from veritab import run

    out = run(spark.range(3), [completeness.null()])
    store = readers.ResultStore(spark, str(tmp_path / "results"))
    store.save(out, "a")
    store.save(out, "b")
    assert store.load().count() == 2 and store.load("a").count() == 1
    memory = readers.MemoryStore(1)
    memory.save(out, "a")
    memory.save(out, "b")
    assert memory.load("a") == [] and memory.load("b")[0]["n_rows"] == 3


def events(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, t0 + dt.timedelta(minutes=7 * i), float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "id long, k long, ts timestamp, x double")


SPEC = {"n": ("count", "*"), "total": ("sum", "x")}


def streamed(spark, df, tmp_path, make):
    late = df.agg(F.max("ts")).first()[0] + dt.timedelta(days=2)
    df.coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    spark.createDataFrame([(99, 9, late, 0.0)], df.schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("memory").queryName("out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    return spark.table("out")


def test_tumbling_stream_equals_batch(spark, tmp_path):
    df = events(spark)
    got = streamed(spark, df, tmp_path, lambda s: windows.tumbling(s, "ts", "1 hour", SPEC, delay="1 minute"))
    assert sorted(got.collect()) == sorted(windows.tumbling(df, "ts", "1 hour", SPEC).collect())


def test_session_stream_equals_batch(spark, tmp_path):
    df = events(spark).where("id % 10 < 6")
    got = streamed(spark, df, tmp_path, lambda s: windows.session(s, "ts", "15 minutes", SPEC, ["k"], delay="1 minute"))
    assert sorted(got.collect()) == sorted(windows.session(df, "ts", "15 minutes", SPEC, ["k"]).collect())


def test_checks_of_micro_batches(spark, tmp_path):
    df = events(spark).withColumn("x", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("x")))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    windows.check_batches(stream, [completeness.null("x")], lambda r, n: r.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp")).awaitTermination()
    total = windows.merged(spark.read.parquet(out)).first()
    assert (total.n_bad, total.n_rows) == (15, 60)


def test_deduplicated_stream(spark, tmp_path):
    df = events(spark)
    got = streamed(spark, df.union(df), tmp_path, lambda s: windows.deduplicated(s, "ts", ["id"], "1 day").select("id", "k", "ts", "x"))
    assert got.where("id < 99").count() == 60
