"""Further registered queries: sources and stores that are written and read back, sketches, samples, growing profiles and streams; and SQL for queries registered elsewhere."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import completeness, distribution, privacy, quantiles, relational, sketches, uniqueness
from ..sources import readers
from ..streaming import windows
from . import checks, incremental, lineage, sdk
from .entries_tables import CATS, QUANTILE_BINS

# sources


def _through_files(t, kind: str, ending: str, **options) -> DataFrame:
    """``supplier`` written as files of a kind and read back by their ending."""
    at = lineage.scratch(t.spark, "source") + ending
    t["supplier"].write.format(kind).options(**options).save(at)
    return readers.load(t.spark, at)


def _through_arrow(t) -> DataFrame:
    import pyarrow as pa

    at = lineage.scratch(t.spark, "source").removeprefix("file:").replace("//", "/") + ".arrow"
    table = t["supplier"].toArrow()  # the file is made here; reading it back is what is shown
    with pa.OSFile(at, "wb") as out, pa.ipc.new_file(out, table.schema) as writer:
        writer.write_table(table, max_chunksize=50)
    return readers.read_file(t.spark, at)


def _through_document(t) -> DataFrame:
    """An array of objects in one JSON document."""
    at = lineage.scratch(t.spark, "source") + ".json"
    rows = t["nation"].select(F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("j"))
    rows.agg(F.concat(F.lit("[\n"), F.array_join(F.sort_array(F.collect_list("j")), ",\n"), F.lit("\n]")).alias("value")).coalesce(1).write.text(at)
    return readers.load(t.spark, at).selectExpr("int(n_nationkey) AS n_nationkey", "n_name", "int(n_regionkey) AS n_regionkey")


def _database(t, name: str, *columns: str) -> str:
    """A table, or columns of it, in a database of this process (Derby comes with Spark), by its URI. It is kept in files until the process ends, so that memory doesn't limit it, and
    texts in columns that hold nulls and any length."""
    at = os.path.realpath(tempfile.mkdtemp(prefix="veritab-"))
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    uri = f"derby:{at}/{name}"
    connection = t.spark._jvm.java.sql.DriverManager.getConnection(readers.jdbc_options(uri)["url"])
    for what, size in (("pageReservedSpace", 0), ("minimumRecordSize", 1)):  # rows don't grow later: no room is left for it
        connection.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.storage.{what}', '{size}')")
    connection.close()
    readers.write_sql(t[name].select(*columns or "*"), uri, name)
    return uri


def _over_jdbc(t) -> DataFrame:
    """Filter and columns go to the database; two tasks read a range of keys each, or the driver all, where only it has the database. Further filters are Spark's: Derby doesn't compare
    texts of any length."""
    wanted = '(SELECT "s_suppkey", "s_name" FROM supplier WHERE "s_acctbal" > 0) AS wanted'
    return readers.read_sql(t.spark, _database(t, "supplier"), wanted, partition_column='"s_suppkey"', bounds=(1, 1000), partitions=2, pushDownPredicate="false")


def _over_jdbc_query(t) -> DataFrame:
    """An aggregation that the database itself runs, over all rows of the column that it asks for."""
    text = 'SELECT "n_regionkey" AS "n_regionkey", count(*) AS "n" FROM nation GROUP BY "n_regionkey"'
    return readers.read_sql(t.spark, _database(t, "nation", "n_regionkey"), query=text).selectExpr("n_regionkey", "bigint(n) AS n")


def _document_schema(t) -> DataFrame:
    documents = t["nation"].select(F.to_json(F.struct("n_nationkey", F.struct("n_name").alias("own"))).alias("j"))
    return t.spark.createDataFrame([(readers.document_schema(documents, "j"),)], "found string")


def _flattened(t) -> DataFrame:
    nested = t["nation"].select("n_nationkey", F.struct("n_name", F.struct("n_regionkey").alias("in")).alias("own"))
    return readers.flatten(nested, "_")


def _decoded(t) -> DataFrame:
    texts = t["orders"].select(F.encode(F.to_json(F.struct("o_orderkey", "o_orderstatus")), "UTF-8").alias("value"))
    return readers.decode_json(texts, "value", "o_orderkey bigint, o_orderstatus string")


def _store(t, at: str | None = None, uri: str | None = None) -> DataFrame:
    """Results of two runs in a store; those of the second are read back."""
    store = readers.ResultStore(t.spark, at, uri)
    for run, source in (("first", "customer"), ("second", "people")):
        columns = ["c_acctbal"] if source == "customer" else ["balance"]
        found = checks.run(t[source], [completeness.null(columns)])
        store.save(found.select("check_name", "column_name", "issue", "n_bad", "n_rows"), run)
    return store.load("second").select("column_name", "issue", "n_bad", "n_rows")


def _memory_store(t) -> DataFrame:
    store = readers.MemoryStore()
    store.save(checks.run(t["people"], [completeness.null(["balance"])]), "only")
    return t.spark.createDataFrame([(r["column_name"], r["n_bad"], r["n_rows"]) for r in store.load("only")], "column_name string, n_bad long, n_rows long")


STORED = "SELECT 'balance' AS column_name, 'null' AS issue, count(*) - count(balance) AS n_bad, count(*) AS n_rows FROM {people}"
SUPPLIER = "SELECT * FROM supplier"


# streams


def _as_stream(t, name: str, columns: list[str]) -> DataFrame:
    """A table as a stream of files, several batches."""
    at = lineage.scratch(t.spark, "stream")
    t[name].select(*columns).repartition(6).write.parquet(at)
    schema = t[name].select(*columns).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(at)


def _checked_stream(t) -> DataFrame:
    """A suite on each batch of a stream; each batch's results overwrite their own folder, so a batch that is run again counts once."""
    at, stream = lineage.scratch(t.spark, "results"), _as_stream(t, "orders", ["o_orderkey", "o_totalprice"])
    suite = [completeness.null(["o_orderkey"]), distribution.between("o_totalprice", 1000, 300_000)]
    sink = lambda results, number: results.write.mode("overwrite").json(f"{at}/batch={number}")
    windows.check_batches(stream, suite, sink, lineage.scratch(t.spark, "checkpoint")).awaitTermination()
    found = t.spark.read.schema(checks.RESULT).json(f"{at}/*")
    return windows.merged(found).select("check_name", "column_name", "n_bad", "n_rows")


def _profiled_stream(t) -> DataFrame:
    at = lineage.scratch(t.spark, "profile")
    incremental.profile_stream(_as_stream(t, "orders", ["o_orderkey", "o_totalprice"]), at, lineage.scratch(t.spark, "checkpoint")).awaitTermination()
    return _numbers(incremental.finished(incremental.merged(t.spark.read.parquet(at).drop("batch"))))


def _numbers(profile: DataFrame) -> DataFrame:
    exact = profile.select("column_name", "n_rows", "n_null", "low", "high", F.round("mean", 4).alias("mean"), F.round(F.log10("std"), 6).alias("log_std"))
    return exact.where("column_name in ('o_totalprice', 'o_orderkey')")


def _deduplicated_stream(t) -> DataFrame:
    """Rows that come twice in a stream, by their content."""
    at = lineage.scratch(t.spark, "rows")
    nation = t["nation"].union(t["nation"])
    source = lineage.scratch(t.spark, "stream")
    nation.repartition(4).write.parquet(source)
    stream = t.spark.readStream.schema(nation.schema).option("maxFilesPerTrigger", 1).parquet(source)
    named = stream.withColumn("content", windows.by_content(stream)).dropDuplicates(["content"]).drop("content")
    named.writeStream.format("parquet").option("path", at).option("checkpointLocation", lineage.scratch(t.spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(at)


def _sampled_batches(t) -> DataFrame:
    """A running sample over four batches."""
    kept = None
    for part in range(4):
        batch = t["orders"].where(F.col("o_orderkey") % 4 == part).select("o_orderkey")
        kept = sketches.reservoir(kept, batch, 50, ["o_orderkey"])
    return kept


DRAW = "('0x' || substr(md5('42/' || {key}::VARCHAR), 1, 8))::BIGINT / 4294967296.0"
ORDER_DRAW = DRAW.format(key="o_orderkey")


# sketches

DEPTH, WIDTH = sketches.count_min_size(0.01, 0.99)
CELL = "('0x' || substr(md5(i || '/' || {v}::VARCHAR), 1, 8))::BIGINT % {w}"
COUNT_MIN_SQL = (
    f"WITH c AS (SELECT i, {CELL.format(v='o_custkey', w=WIDTH)} AS cell, count(*) AS n FROM orders, range({DEPTH}) AS r(i) GROUP BY 1, 2), "
    f"a AS (SELECT c_custkey, i, {CELL.format(v='c_custkey', w=WIDTH)} AS cell FROM customer, range({DEPTH}) AS r(i)) "
    "SELECT c_custkey, min(coalesce(n, 0))::BIGINT AS n FROM a LEFT JOIN c USING (i, cell) GROUP BY 1"
)
HASHES, BITS = sketches.bloom_size(20_000, 0.01)
BLOOM_SQL = (
    f"WITH f AS (SELECT DISTINCT {CELL.format(v='o_custkey', w=BITS)} AS bit FROM orders, range({HASHES}) AS r(i)), "
    f"a AS (SELECT c_custkey, {CELL.format(v='c_custkey', w=BITS)} AS bit FROM customer, range({HASHES}) AS r(i)) "
    "SELECT c_custkey FROM a LEFT JOIN f USING (bit) GROUP BY 1 HAVING bool_and(f.bit IS NOT NULL)"
)


def _sketched(t) -> DataFrame:
    """A sketch of each order status, merged, asked for quantiles."""
    own = quantiles.sketch(t["orders"], "o_totalprice", group_by=["o_orderstatus"])
    return quantiles.sketch_quantiles(quantiles.merged_sketches(own), [0.1, 0.5, 0.9])


# geography

VALID = "abs(lat) <= 90 AND abs(lon) <= 180"
KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"
BETWEEN = KM.format(a="a.lat", b="b.lat", c="a.lon", d="b.lon")


def _asked(t) -> tuple[DataFrame, DataFrame]:
    """The query set, places whose id is divisible by 50, and all places."""
    valid = t["places"].where(VALID)
    return valid.where("id % 50 = 0").select("id", "lat", "lon"), valid.select(F.col("id").alias("pid"), "lat", "lon")


def _k_nearest(t) -> DataFrame:
    found = geo.k_nearest(*_asked(t), "id", "pid", "lat", "lon", 3)
    return found.select("id", "pid", F.round("distance", 3).alias("distance"), "place")


def _pairwise(t) -> DataFrame:
    found = geo.distance_summary(*_asked(t), "id", "lat", "lon")
    return found.select("id", "n", F.round("mean", 3).alias("mean"), F.round("farthest", 3).alias("farthest"))


# engine


def _arrays(t) -> DataFrame:
    got = readers.to_numpy(t["nation"].select("n_nationkey", "n_regionkey"))
    return t.spark.createDataFrame([(int(got["n_nationkey"].sum()), int(got["n_regionkey"].sum()))], "keys long, regions long")


def _persisted(t) -> DataFrame:
    kept = readers.persisted(t["orders"].where("o_totalprice > 200000"))
    return kept.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _checkpointed(t) -> DataFrame:
    return lineage.cut(t["orders"].groupBy("o_orderpriority").agg(F.count("*").alias("n")))


def _hooked(t) -> DataFrame:
    """Hooks before and after a run: one writes down the checks' names, one the results' columns with nulls."""
    seen: list[tuple[str, str]] = []
    hooks = sdk.Hooks()
    hooks.before.append(lambda df, made: seen.extend(("before", check.name) for check in made))
    hooks.after.append(lambda out: seen.extend(("after", r["column_name"]) for r in out.where("n_bad > 0").collect()))
    hooks.run(t["people"], [completeness.null(["balance", "id"]), uniqueness.unique("id")])
    return t.spark.createDataFrame(seen, "moment string, name string")


def _registered(t) -> DataFrame:
    """Checks made by name, as the registry finds them."""
    known = sdk.registry()
    made = [known["null"](["balance"]), known["unique"]("id"), known["between"]("age", 0, 100)]
    return checks.run(t["people"], made).select("check_name", "column_name", "n_bad", "n_rows")


MORE_TABLES = [
    ("source_csv", lambda t: _through_files(t, "csv", ".csv", header=True).selectExpr("int(s_suppkey) AS s_suppkey", "s_name", "int(s_nationkey) AS s_nationkey", "s_acctbal"), SUPPLIER),
    ("source_tsv", lambda t: _through_files(t, "csv", ".tsv", header=True, sep="\t").selectExpr("int(s_suppkey) AS s_suppkey", "s_name", "int(s_nationkey) AS s_nationkey", "s_acctbal"), SUPPLIER),
    ("source_json_lines", lambda t: _through_files(t, "json", ".jsonl").selectExpr("int(s_suppkey) AS s_suppkey", "s_name", "int(s_nationkey) AS s_nationkey", "s_acctbal"), SUPPLIER),
    ("source_parquet", lambda t: _through_files(t, "parquet", ".parquet"), SUPPLIER),
    ("source_orc", lambda t: _through_files(t, "orc", ".orc"), SUPPLIER),
    ("source_arrow_ipc", _through_arrow, SUPPLIER),
    ("source_json_document", _through_document, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    ("source_dict", lambda t: readers.load(t.spark, {"k": [1, 2, 3], "v": ["a", None, "c"]}), "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, NULL), (3, 'c')) AS v(k, v)"),
    ("source_pandas", lambda t: readers.load(t.spark, t["nation"].select("n_nationkey", "n_name").toPandas()), "SELECT n_nationkey, n_name FROM nation"),
    ("source_config", lambda t: readers.load(t.spark, {"kind": "file", "path": f"{t.sf_dir}/region.parquet"}).select("r_regionkey", "r_name"), "SELECT r_regionkey, r_name FROM region"),
    ("source_jdbc", _over_jdbc, "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0"),
    ("source_jdbc_query", _over_jdbc_query, "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1"),
    ("document_schema", _document_schema, "SELECT 'struct<n_nationkey:bigint,own:struct<n_name:string>>' AS found FROM nation LIMIT 1"),
    ("flatten_documents", _flattened, "SELECT n_nationkey, n_name AS own_n_name, n_regionkey AS own_in_n_regionkey FROM nation"),
    ("decode_json", _decoded, "SELECT o_orderkey, o_orderstatus FROM orders"),
    ("store_files", lambda t: _store(t, lineage.scratch(t.spark, "store")), STORED),
    ("store_database", lambda t: _store(t, uri=f"derby:memory:{lineage.scratch(t.spark, 'store').rsplit('/', 1)[1].replace('-', '')}"), STORED),
    ("store_memory", _memory_store, "SELECT 'balance' AS column_name, count(*) - count(balance) AS n_bad, count(*) AS n_rows FROM {people}"),
    ("stream_checks", _checked_stream, "SELECT 'null' AS check_name, 'o_orderkey' AS column_name, count(*) - count(o_orderkey) AS n_bad, count(*) AS n_rows FROM orders UNION ALL SELECT 'between', 'o_totalprice', count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 300000), count(o_totalprice) FROM orders"),
    ("stream_profile", _profiled_stream, " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, round(log10(stddev_samp({c})), 6) AS log_std FROM orders" for c in ("o_orderkey", "o_totalprice"))),
    ("stream_deduplicate", _deduplicated_stream, "SELECT * FROM nation"),
    ("stream_aggregate_join", lambda t: windows.aggregated_with(t["orders"].withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], {"n": ("count", "*"), "top": ("max", "o_totalprice")}, t["customer"].select("c_custkey", "c_name")), "SELECT c_custkey, c_name, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"),
    ("incremental_profile", lambda t: _numbers(incremental.finished(incremental.merged(incremental.state(t["baseline"]), incremental.state(t["shifted"])))), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 4) AS mean, round(log10(stddev_samp({c})), 6) AS log_std FROM (SELECT o_orderkey, o_totalprice FROM {{baseline}} UNION ALL SELECT o_orderkey, o_totalprice FROM {{shifted}})" for c in ("o_orderkey", "o_totalprice"))),
    ("count_min_sketch", lambda t: _count_min(t), COUNT_MIN_SQL),
    ("heavy_hitters", lambda t: sketches.heavy_hitters(t["lineitem"], "l_returnflag", 0.3), "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 0.3 * (SELECT count(*) FROM lineitem)"),
    ("bloom_filter", lambda t: sketches.might_contain(sketches.bloom(t["orders"], "o_custkey", 20_000), t["customer"], "c_custkey", 20_000), BLOOM_SQL),
    ("quantile_sketch", _sketched, ""),
    ("sample_share", lambda t: sketches.sample_share(t["orders"], 0.1, ["o_orderkey"]).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE {ORDER_DRAW} < 0.1"),
    ("sample_blocks", lambda t: sketches.sample_blocks(t["orders"], 0.2, "o_orderkey", 100).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE {DRAW.format(key='floor(o_orderkey / 100)::BIGINT')} < 0.2"),
    ("sample_strata", lambda t: sketches.sample_strata(t["orders"], "o_orderstatus", 20, ["o_orderkey"]).select("o_orderstatus", "o_orderkey"), f"SELECT o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {ORDER_DRAW}, o_orderkey) AS r FROM orders) WHERE r <= 20"),
    ("sample_reservoir", _sampled_batches, f"SELECT o_orderkey FROM orders ORDER BY {ORDER_DRAW}, o_orderkey LIMIT 50"),
    ("memory_estimate", lambda t: sketches.memory_estimate(t["orders"].select("o_orderkey", "o_totalprice", "o_orderstatus")), "SELECT 'o_orderkey' AS column_name, count(o_orderkey) * 8 AS bytes FROM orders UNION ALL SELECT 'o_totalprice', count(o_totalprice) * 8 FROM orders UNION ALL SELECT 'o_orderstatus', sum(strlen(o_orderstatus))::BIGINT FROM orders"),
    ("k_nearest_points", _k_nearest, f"SELECT id, pid, round(d, 3) AS distance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, pid) AS place FROM (SELECT a.id, b.id AS pid, {BETWEEN} AS d FROM (SELECT * FROM {{places}}) a, (SELECT * FROM {{places}}) b WHERE a.id % 50 = 0 AND abs(a.lat) <= 90 AND abs(a.lon) <= 180 AND abs(b.lat) <= 90 AND abs(b.lon) <= 180)) WHERE place <= 3"),
    ("pairwise_distances", _pairwise, f"SELECT a.id, count(*) AS n, round(avg({BETWEEN}), 3) AS mean, round(max({BETWEEN}), 3) AS farthest FROM (SELECT * FROM {{places}}) a, (SELECT * FROM {{places}}) b WHERE a.id % 50 = 0 AND abs(a.lat) <= 90 AND abs(a.lon) <= 180 AND abs(b.lat) <= 90 AND abs(b.lon) <= 180 GROUP BY 1"),
    ("to_numpy", _arrays, "SELECT sum(n_nationkey)::BIGINT AS keys, sum(n_regionkey)::BIGINT AS regions FROM nation"),
    ("persisted", _persisted, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1"),
    ("checkpointed", _checkpointed, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"),
    ("repartitioned", lambda t: relational.partition_sizes(t["lineitem"].repartition(8, "l_orderkey")).agg(F.sum("n").alias("n")), "SELECT count(*) AS n FROM lineitem"),
    ("registry", _registered, "SELECT 'null' AS check_name, 'balance' AS column_name, count(*) - count(balance) AS n_bad, count(*) AS n_rows FROM {people} UNION ALL SELECT 'unique', 'id', count(id) - count(DISTINCT id), count(id) FROM {people} UNION ALL SELECT 'between', 'age', count(*) FILTER (WHERE age < 0 OR age > 100), count(age) FROM {people}"),
    ("hooks", _hooked, "SELECT 'before' AS moment, 'null' AS name UNION ALL SELECT 'before', 'unique' UNION ALL SELECT 'after', c FROM (SELECT 'balance' AS c, count(*) - count(balance) AS n FROM {people} UNION ALL SELECT 'id', count(*) - count(id) FROM {people} UNION ALL SELECT 'id', count(id) - count(DISTINCT id) FROM {people}) WHERE n > 0"),
    ("sample", lambda t: readers.sample(t["orders"].select("o_orderkey"), 100), f"SELECT o_orderkey FROM orders ORDER BY {ORDER_DRAW}, o_orderkey LIMIT 100"),
]


def _count_min(t) -> DataFrame:
    asked = t["customer"].select("c_custkey")
    return sketches.count_min_estimates(sketches.count_min(t["orders"], "o_custkey", 0.01), asked, "c_custkey", 0.01)


# SQL of queries that are registered elsewhere

FG = """(SELECT x, c, sum(a) OVER w / n AS f, sum(b) OVER w / m AS g, n, m
    FROM (SELECT x, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, count(*)::DOUBLE AS c FROM (SELECT o_totalprice AS x, 1 AS a, 0 AS b FROM {shifted} UNION ALL SELECT o_totalprice, 0, 1 FROM {baseline}) GROUP BY x),
         (SELECT (SELECT count(*) FROM {shifted})::DOUBLE AS n, (SELECT count(*) FROM {baseline})::DOUBLE AS m) WINDOW w AS (ORDER BY x))"""
SERIES = "s AS (SELECT row_number() OVER (ORDER BY ts, value) - 1 AS i, value AS x FROM {daily} WHERE ts IS NOT NULL AND value IS NOT NULL)"
CENTRED = f"{SERIES}, l AS (SELECT regr_slope(x, i) AS k, regr_intercept(x, i) AS b FROM s), c AS (SELECT i, x - b - k * i AS x FROM s, l), z AS (SELECT i, x - (SELECT avg(x) FROM c) AS x FROM c)"
ACF = "(SELECT sum(a.x * b.x) FROM z a JOIN z b ON b.i = a.i + {lag}) / (SELECT sum(x * x) FROM z)"
RESULT = "SELECT '{check}' AS check_name, '{column}' AS column_name, '{issue}' AS issue, "


def _one(check: str, column: str, issue: str, bad: str, value: str, level: str) -> str:
    """A result row of a check that gives one value ``v``."""
    return f"SELECT '{check}' AS check_name, '{column}' AS column_name, '{issue}' AS issue, ({bad})::BIGINT AS n_bad, 1::BIGINT AS n_rows, round({value}, 4) AS actual, CASE WHEN ({bad}) > 0 THEN {level} END AS severity"


def _law(check: str, laws: tuple[str, ...]) -> str:
    """What `privacy.compliance` finds in ``people``: a row for each column named like a kind of data of the law, and one for each text column whose values look like one."""
    columns = ("id", "balance", "name", "segment", "nation", "email", "phone", "url", "ip_address", "ip6", "uuid", "day", "mixed", "reading", "age", "consent")
    texts = ("name", "segment", "email", "phone", "url", "ip_address", "ip6", "uuid", "day", "mixed", "consent")
    parts = []
    for law in laws:
        kinds = {k: v for k, v in privacy.KINDS.items() if law in v[2]}
        hinted = [(c, k) for c in columns for k, (words, _, _) in kinds.items() if any(w in c for w in words)]
        parts += [f"SELECT '{check}' AS check_name, '{c}' AS column_name, '{law}_{k}' AS issue, 1::BIGINT AS n_bad, 1::BIGINT AS n_rows, NULL::DOUBLE AS actual, 'high' AS severity" for c, k in hinted]
        if not hinted:
            parts.append(f"SELECT '{check}', '*', 'no_hint', 0, 1, NULL, NULL")
        tests = []
        for i, (c, k) in enumerate((c, k) for c in texts for k, v in kinds.items() if v[1]):
            words, pattern, _ = kinds[k]
            hint = 10 if any(w in c for w in words) else 0
            tests.append(f"SELECT '{c}' AS c, '{k}' AS k, {hint} AS hint, {i} AS i, count({c}) AS n, count(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) AS m FROM {{people}}")
        graded = f"SELECT *, 80 + hint + CASE WHEN m > 0.8 * n THEN 5 ELSE 0 END - CASE WHEN m < 0.3 * n THEN 20 ELSE 0 END AS grade FROM ({' UNION ALL '.join(tests)}) WHERE m >= 0.1 * n AND n > 0"
        best = f"SELECT *, row_number() OVER (PARTITION BY c ORDER BY grade DESC, i) AS r FROM ({graded}) WHERE grade >= 50"
        parts.append(f"SELECT '{check}', c, '{law}_' || k, m, n, grade::DOUBLE, CASE WHEN grade >= 85 THEN 'high' ELSE 'medium' END FROM ({best}) WHERE r = 1")
    return " UNION ALL ".join(parts)


PSI = "sum((greatest(p, 1e-4) - greatest(q, 1e-4)) * ln(greatest(p, 1e-4) / greatest(q, 1e-4)))"
PSI_LEVEL = "CASE WHEN round(v, 4) >= 0.5 THEN 'critical' WHEN round(v, 4) >= 0.375 THEN 'high' ELSE 'medium' END"
PSI_BAD = "CASE WHEN v >= 0.25 THEN 1 ELSE 0 END"
# three statuses: two degrees of freedom, whose upper quantile of 5 % is 5.9915
CHI2 = f"(WITH s AS (SELECT p * n AS a, q * n AS e FROM {CATS}, (SELECT count(*) AS n FROM {{shifted}}) WHERE q * n >= 5), t AS (SELECT sum(a) AS ta, sum(e) AS te FROM s) SELECT sum(pow(a - e * ta / te, 2) / (e * ta / te)) AS v FROM s, t)"
MOMENTS = "SELECT count(*) AS n, count(o_totalprice) AS c, count(DISTINCT o_totalprice) AS d, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM"
ASPECTS = {"completeness": ("c::DOUBLE / n", False), "uniqueness": ("d::DOUBLE / n", False), "mean": ("mean", True), "minimum": ("low", True), "maximum": ("high", True), "cardinality": ("d::DOUBLE", True)}
COMPARED = f"WITH a AS ({MOMENTS} {{baseline}}), b AS ({MOMENTS} {{shifted}}) " + " UNION ALL ".join(
    f"SELECT 'o_totalprice' AS column_name, '{k}' AS aspect, round(was, 2) AS was, round(now, 2) AS now, abs(now - was) {'/ abs(was) ' if relative else ''}> 0.1 AS drifted FROM (SELECT {e} AS was FROM a), (SELECT {e} AS now FROM b)"
    for k, (e, relative) in ASPECTS.items()
)

ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
SUITED = " UNION ALL ".join(
    [
        f"SELECT 'unique' AS check_name, '{c}' AS column_name, n AS n_bad FROM (SELECT count({c}) - count(DISTINCT {c}) AS n FROM {{shifted}}), (SELECT count(*) = count(DISTINCT {c}) AS u FROM {{baseline}}) WHERE u AND n > 0"
        for c in ORDERS
    ]
    + [
        f"SELECT 'between', '{c}', n FROM (SELECT count(*) FILTER (WHERE {c} < low - 0.1 * (high - low) OR {c} > high + 0.1 * (high - low)) AS n FROM (SELECT {c} FROM {{shifted}}), (SELECT min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM {{baseline}})) WHERE n > 0"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    ]
)

CODES = ("card", "isbn", "iban", "vat", "swift", "chinese", "uscc", "postal", "mynumber", "business", "rrn", "kphone", "account", "bank")
PLUGIN = " UNION ALL ".join(
    f"SELECT 'plugin_based_privacy' AS check_name, '{c}' AS column_name, 'pci_dss_card' AS issue, n_bad, n_rows, NULL::DOUBLE AS actual, CASE WHEN n_bad > 0.1 * n_rows THEN 'high' END AS severity "
    f"FROM (SELECT count(*) FILTER (WHERE regexp_matches({c}, '^[0-9]{{13,19}}$')) AS n_bad, count({c}) AS n_rows FROM {{codes}})"
    for c in CODES
)

LEARNED = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{kind}' AS kind, count(*) > count({c}) AS nullable, count(*) = count(DISTINCT {c}) AS is_unique, "
    + (f"CASE WHEN count(DISTINCT {c}) BETWEEN 1 AND 20 THEN count(DISTINCT {c}) ELSE 0 END::INT" if kind == "string" else "0::INT")
    + " AS n_allowed FROM orders"
    for c, kind in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))
)

MORE_SQL = {
    "drift_cvm": f"SELECT round(max(n * m / (n + m)) * sum((f - g) * (f - g) * c / (n + m)), 4) AS value FROM {FG}",
    "drift_anderson": f"SELECT round(max(n * m / (n + m)) * sum(CASE WHEN p > 0 AND p < 1 THEN (f - g) * (f - g) * c / (n + m) / (p * (1 - p)) ELSE 0 END), 4) AS value FROM (SELECT *, (n * f + m * g) / (n + m) AS p FROM {FG})",
    "drift_mmd": "WITH s AS (SELECT stddev_pop(o_totalprice) AS s FROM {baseline}), v AS (SELECT o_totalprice / s AS x, 1.0::DOUBLE / (SELECT count(*) FROM {shifted}) AS w FROM {shifted}, s UNION ALL SELECT o_totalprice / s, -1.0::DOUBLE / (SELECT count(*) FROM {baseline}) FROM {baseline}, s) SELECT round(greatest(sum(a.w * b.w * exp(-(a.x - b.x) * (a.x - b.x) / 2)), 0), 4) AS value FROM v a, v b",
    "autocorrelation": f"WITH {CENTRED} " + " UNION ALL ".join(f"SELECT {lag}::INT AS lag, round({ACF.format(lag=lag)}, 4) AS acf" for lag in (1, 7)),
    "seasonality": f"WITH {CENTRED}, v AS (SELECT {ACF.format(lag=7)} AS v) " + _one("seasonality", "value", "weak_seasonality", "CASE WHEN v < 0.3 THEN 1 ELSE 0 END", "v", "'low'") + " FROM v",
    "seasonal_decomposition": f"WITH {SERIES}, t AS (SELECT i, x, avg(x) OVER w AS t, count(*) OVER w AS n FROM s WINDOW w AS (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), d AS (SELECT x, x - t AS d, avg(x - t) OVER (PARTITION BY i % 7) AS season FROM t WHERE n = 7), v AS (SELECT var_pop(d - season) / var_pop(x) AS v FROM d) "
    + _one("seasonal_decomposition", "value", "large_residual", "CASE WHEN v > 0.3 THEN 1 ELSE 0 END", "v", "'medium'")
    + " FROM v",
    "trend_break": f"WITH {SERIES}, a AS (SELECT i, avg(x) OVER w AS after, count(*) OVER w AS n FROM s WINDOW w AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)), c AS (SELECT a.i, abs((a.after - b.after) / abs(b.after)) AS c FROM a JOIN a b ON a.i = b.i + 10 WHERE a.n = 10 AND b.n = 10), p AS (SELECT c, max(c) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS top FROM c), v AS (SELECT count(*) FILTER (WHERE c >= 0.5 AND c >= top) AS v FROM p) "
    "SELECT 'trend_break' AS check_name, 'value' AS column_name, 'trend_break' AS issue, v AS n_bad, v AS n_rows, v::DOUBLE AS actual, CASE WHEN v > 0 THEN 'medium' END AS severity FROM v",
    "gdpr_compliance": _law("gdpr_compliance", ("gdpr",)),
    "ccpa_compliance": _law("ccpa_compliance", ("ccpa",)),
    "lgpd_compliance": _law("lgpd_compliance", ("lgpd",)),
    "pipeda_compliance": _law("pipeda_compliance", ("pipeda",)),
    "appi_compliance": _law("appi_compliance", ("appi",)),
    "global_privacy": _law("global_privacy", ("gdpr", "ccpa")),
    "plugin_based_privacy": PLUGIN,
    "learn": LEARNED,
    "compare": f"SELECT 'o_totalprice' AS column_name, 'psi' AS method, round(v, 4) AS statistic, 0.1::DOUBLE AS threshold, v >= 0.1 AS drifted FROM (SELECT {PSI} AS v FROM {QUANTILE_BINS}) UNION ALL SELECT 'o_orderstatus', 'chi2', round(v, 4), 0.05, v > 5.991464547 FROM {CHI2}",
    "feature_drift": _one("feature_drift", "o_totalprice", "psi_drift", PSI_BAD, "v", PSI_LEVEL) + f" FROM (SELECT {PSI} AS v FROM {QUANTILE_BINS}) UNION ALL " + _one("feature_drift", "o_orderstatus", "psi_drift", PSI_BAD, "v", PSI_LEVEL) + f" FROM (SELECT {PSI} AS v FROM {CATS})",
    "profile_comparator": COMPARED,
    "suite_from_profile": SUITED,
    "ml_ensemble": "SELECT event_id FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) WHERE abs(value - m) / s > 2.0 AND (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))",
    "ml_concept_drift": "WITH e AS (SELECT date_trunc('day', ts) AS part, event_id AS seq, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS e FROM events), "
    "r AS (SELECT part, seq, row_number() OVER w AS n, sum(e) OVER w::DOUBLE / row_number() OVER w AS p FROM e WINDOW w AS (PARTITION BY part ORDER BY seq ROWS UNBOUNDED PRECEDING)), "
    "q AS (SELECT *, sqrt(p * (1 - p) / n) AS s FROM r), l AS (SELECT *, min(CASE WHEN n >= 30 THEN struct_pack(a := p + s, n := n, p := p, s := s) END) OVER (PARTITION BY part ORDER BY seq ROWS UNBOUNDED PRECEDING) AS low FROM q), "
    "j AS (SELECT part, seq, n, p + s > low.p + 3 * low.s AS drifts, p + s > low.p + 2 * low.s AS warns FROM l) "
    "SELECT part, max(n)::BIGINT AS n, CASE WHEN count(*) FILTER (WHERE drifts) > 0 THEN 'drift' WHEN count(*) FILTER (WHERE warns) > 0 THEN 'warning' ELSE 'stable' END AS state, min(seq) FILTER (WHERE drifts)::BIGINT AS at FROM j GROUP BY part",
}
