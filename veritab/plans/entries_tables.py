"""Registered table functions: name, the query, and its SQL ("" where SQL can't express it: neighbours are held against brute force in the tests, forests against planted rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..ml import detectors
from ..operators import drift, ml_feature, privacy, profiling, referential, relational, timeseries, uniqueness
from ..streaming import windows
from . import profile
from .checks import run

SPEC = {"n": ("count", "*"), "total": ("sum", "o_totalprice"), "top": ("max", "o_totalprice")}


def _r(df: DataFrame, digits: int = 4) -> DataFrame:
    """Rounded, so that sums in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _drift_one(method: str):
    return lambda t: _r(drift._statistic(t["shifted"], t["baseline"], "o_totalprice", method, False).select("value"))


CATS = "(SELECT coalesce(a.v, b.v) AS v, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM (SELECT o_orderstatus AS v, count(*)::DOUBLE / (SELECT count(*) FROM {shifted}) AS p FROM {shifted} GROUP BY 1) a FULL JOIN (SELECT o_orderstatus AS v, count(*)::DOUBLE / (SELECT count(*) FROM {baseline}) AS p FROM {baseline} GROUP BY 1) b ON a.v = b.v)"
ECDF = "(SELECT x, sum(a) OVER (ORDER BY x)::DOUBLE / (SELECT count(*) FROM {shifted}) AS f, sum(b) OVER (ORDER BY x)::DOUBLE / (SELECT count(*) FROM {baseline}) AS g, lead(x) OVER (ORDER BY x) - x AS w FROM (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT o_totalprice AS x, 1 AS a, 0 AS b FROM {shifted} UNION ALL SELECT o_totalprice, 0, 1 FROM {baseline}) GROUP BY x))"
EQUAL_BINS = "(SELECT bin, count(*) FILTER (WHERE side = 0)::DOUBLE / (SELECT count(*) FROM {shifted}) AS p, count(*) FILTER (WHERE side = 1)::DOUBLE / (SELECT count(*) FROM {baseline}) AS q FROM (SELECT side, least(floor((x - lo) / ((hi - lo) / 10)), 9) AS bin FROM (SELECT o_totalprice AS x, 0 AS side FROM {shifted} UNION ALL SELECT o_totalprice, 1 FROM {baseline}), (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM (SELECT o_totalprice FROM {shifted} UNION ALL SELECT o_totalprice FROM {baseline}))) GROUP BY bin)"
QUANTILE_BINS = "(SELECT b.bin, coalesce(n0, 0)::DOUBLE / (SELECT count(*) FROM {shifted} WHERE o_totalprice BETWEEN (SELECT min(o_totalprice) FROM {baseline}) AND (SELECT max(o_totalprice) FROM {baseline})) AS p, n1::DOUBLE / (SELECT count(*) FROM {baseline}) AS q FROM (SELECT least(len(list_filter(e, lambda y: y <= o_totalprice)), 10) AS bin, count(*) AS n1 FROM {baseline}, (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM {baseline}) GROUP BY 1) b LEFT JOIN (SELECT least(len(list_filter(e, lambda y: y <= o_totalprice)), 10) AS bin, count(*) AS n0 FROM {shifted}, (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM {baseline}) WHERE o_totalprice >= e[1] AND o_totalprice <= e[11] GROUP BY 1) a USING (bin))"

WINDOW_SPEC = {"n": ("count", "*"), "total": ("sum", "value"), "mean": ("avg", "value"), "low": ("min", "value"), "high": ("max", "value")}
TOTALS = "count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 8) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high"
KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"


MUTUAL = "WITH m AS (SELECT min(l_quantity) AS a0, max(l_quantity) AS a1, min(l_extendedprice) AS b0, max(l_extendedprice) AS b1, count(*) AS n FROM lineitem), j AS (SELECT least(floor((l_quantity - a0) / ((a1 - a0) / 10)), 9) AS x, least(floor((l_extendedprice - b0) / ((b1 - b0) / 10)), 9) AS y, count(*)::DOUBLE / max(n) AS p FROM lineitem, m GROUP BY 1, 2) SELECT round(sum(p * ln(p / (px * py))), 4) AS mi FROM j JOIN (SELECT x, sum(p) AS px FROM j GROUP BY x) USING (x) JOIN (SELECT y, sum(p) AS py FROM j GROUP BY y) USING (y)"


def _points(t) -> DataFrame:
    return t["places"].where("abs(lat) <= 90 AND abs(lon) <= 180")


def _profile(t) -> DataFrame:
    out = profile.profile(t["people"], ["balance", "name", "nation"])
    return _r(out.select("column_name", "n_rows", "n_null", "n_distinct", "mean", "std", "q1", "median", "q3", "min_length", "max_length", "mean_length", "n_empty"))


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, {', '.join((f'round({e}({c}), 4)' if num else 'NULL::DOUBLE') + f' AS {a}' for e, a in (('avg', 'mean'), ('stddev_samp', 'std')))}, "
    + ", ".join((f"round(quantile_cont({c}, {p}), 4)" if num else "NULL::DOUBLE") + f" AS {a}" for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
    + ", "
    + ("NULL::INT AS min_length, NULL::INT AS max_length, NULL::DOUBLE AS mean_length, NULL::BIGINT AS n_empty" if num else f"min(length({c}))::INT AS min_length, max(length({c}))::INT AS max_length, round(avg(length({c})), 4) AS mean_length, count(*) FILTER (WHERE {c} = '') AS n_empty")
    + " FROM {people}"
    for c, num in (("balance", True), ("name", False), ("nation", True))
)


def _suite(t) -> DataFrame:
    """A suite made from one half of orders, run on the other."""
    made = profile.suite(t["baseline"])
    return run(t["shifted"], made).where(F.col("severity").isNotNull()).select("check_name", "column_name", "n_bad")


def _matrix(t) -> DataFrame:
    return t["lineitem"].groupBy().agg(F.count("*").alias("n"), F.round(F.covar_samp("l_quantity", "l_extendedprice"), 2).alias("covariance"), F.round(F.avg("l_quantity"), 4).alias("mean"))


TABLES = [
    # entry points
    ("profile", _profile, PROFILE_SQL),
    ("learn", lambda t: t.spark.createDataFrame([(c, r["type"], r["nullable"], r["unique"], len(r.get("allowed", []))) for c, r in profile.learn(t["orders"]).items()], "column_name string, kind string, nullable boolean, is_unique boolean, n_allowed int"), ""),
    ("scan_pii", lambda t: privacy.scan(t["people"].select("email", "ip_address", "name")), "SELECT 'email' AS column_name, 'email' AS kind, count(*) FILTER (WHERE email LIKE '%@%') AS n_match, count(*) AS n_values, CASE WHEN count(*) FILTER (WHERE email LIKE '%@%')::DOUBLE / count(*) > 0.8 THEN 95 ELSE 90 END::INT AS confidence FROM {people} UNION ALL SELECT 'ip_address', 'ip_address', count(*) FILTER (WHERE ip_address NOT LIKE '%.256'), count(*), CASE WHEN count(*) FILTER (WHERE ip_address NOT LIKE '%.256')::DOUBLE / count(*) > 0.8 THEN 95 ELSE 90 END::INT FROM {people}"),
    ("pii_in_text", lambda t: privacy.found_in_text(t["documents"], "text"), "SELECT kind, count(*) FILTER (WHERE n > 0) AS n_rows, sum(n)::BIGINT AS n_found FROM (SELECT k.kind, len(regexp_extract_all(text, k.p)) AS n FROM documents, (VALUES ('email', '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}'), ('ip_address', '\\b(?:\\d{1,3}\\.){3}\\d{1,3}\\b'), ('us_ssn', '\\b\\d{3}-\\d{2}-\\d{4}\\b'), ('credit_card', '\\b\\d{4}[ -]?\\d{4}[ -]?\\d{4}[ -]?\\d{4}\\b')) AS k(kind, p)) GROUP BY kind"),
    ("mask_redact", lambda t: privacy.mask(t["people"].select("id", "email", "phone"), ["email", "phone"]), "SELECT id, CASE WHEN regexp_full_match(email, '[^@\\s]+@[^@\\s]+') THEN regexp_replace(email, '[^@.]', '*', 'g') ELSE repeat('*', length(email)) END AS email, CASE WHEN phone = '12-34' THEN '**-**' ELSE repeat('*', length(phone)) END AS phone FROM {people}"),
    ("mask_hash", lambda t: privacy.mask(t["people"].select("id", "email"), ["email"], "hash"), "SELECT id, substr(sha256(email), 1, 16) AS email FROM {people}"),
    ("mask_fake", lambda t: privacy.mask(t["people"].select("id", "email"), ["email"], "fake").select("id", F.col("email").like("%@example.com").alias("is_mail")), "SELECT id, regexp_full_match(email, '[^@\\s]+@[^@\\s]+') AS is_mail FROM {people}"),
    ("suite_from_profile", _suite, ""),
    ("compare", lambda t: drift.compare(t["baseline"], t["shifted"], ["o_totalprice", "o_orderstatus"]), ""),
    # drift statistics
    ("drift_tv", lambda t: _r(drift._statistic(t["shifted"], t["baseline"], "o_orderstatus", "tv", True).select("value")), f"SELECT round(sum(abs(p - q)) / 2, 4) AS value FROM {CATS}"),
    ("drift_hellinger", lambda t: _r(drift._statistic(t["shifted"], t["baseline"], "o_orderstatus", "hellinger", True).select("value")), f"SELECT round(sqrt(greatest(1 - sum(sqrt(p * q)), 0)), 4) AS value FROM {CATS}"),
    ("drift_bhattacharyya", lambda t: _r(drift._statistic(t["shifted"], t["baseline"], "o_orderstatus", "bhattacharyya", True).select("value")), f"SELECT round(-ln(sum(sqrt(p * q))), 4) AS value FROM {CATS}"),
    ("drift_kl", _drift_one("kl"), f"SELECT round(sum(CASE WHEN p > 0 THEN p * ln(p / greatest(q, 1e-10)) ELSE 0 END), 4) AS value FROM {EQUAL_BINS}"),
    ("js_divergence", _drift_one("js"), f"SELECT round(sqrt(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2), 4) AS value FROM {EQUAL_BINS}"),
    ("psi", _drift_one("psi"), f"SELECT round(sum((greatest(p, 1e-4) - greatest(q, 1e-4)) * ln(greatest(p, 1e-4) / greatest(q, 1e-4))), 4) AS value FROM {QUANTILE_BINS}"),
    ("csi", lambda t: _r(run(t["shifted"], [drift.csi("o_totalprice", t["baseline"], 0.001)]).select("n_bad", "actual")), f"SELECT count(*) FILTER (WHERE x > 0.001) AS n_bad, round(max(x), 4) AS actual FROM (SELECT (greatest(p, 1e-4) - greatest(q, 1e-4)) * ln(greatest(p, 1e-4) / greatest(q, 1e-4)) AS x FROM {QUANTILE_BINS})"),
    ("ks_test", _drift_one("ks"), f"SELECT round(max(abs(f - g)), 4) AS value FROM {ECDF}"),
    ("wasserstein_drift", _drift_one("wasserstein"), f"SELECT round(sum(abs(f - g) * w) / (SELECT stddev_pop(o_totalprice) FROM {{baseline}}), 4) AS value FROM {ECDF}"),
    ("drift_energy", _drift_one("energy"), f"SELECT round(sqrt(2 * sum((f - g) * (f - g) * w)) / sqrt((SELECT stddev_pop(o_totalprice) FROM {{baseline}})), 4) AS value FROM {ECDF}"),
    ("drift_cvm", _drift_one("cvm"), ""),
    ("drift_anderson", _drift_one("anderson"), ""),
    ("drift_mmd", _drift_one("mmd"), ""),
    ("multi_table_orphan", lambda t: referential.multi_table_orphan({"orders": t["children"], "customer": t["customer"], "nation": t["nation"]}, [referential.Relation("orders", ("customer",), "customer", ("c_custkey",)), referential.Relation("customer", ("c_nationkey",), "nation", ("n_nationkey",))]).select("column_name", "n_bad", "n_rows"), "SELECT 'orders.customer' AS column_name, count(*) FILTER (WHERE customer NOT IN (SELECT c_custkey FROM customer)) AS n_bad, count(*) AS n_rows FROM {children} UNION ALL SELECT 'customer.c_nationkey', count(*) FILTER (WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)), count(*) FROM customer"),
    ("cascade_integrity", lambda t: referential.cascade_integrity({"orders": t["children"], "customer": t["customer"]}, [referential.Relation("orders", ("customer",), "customer", ("c_custkey",)), referential.Relation("orders", ("customer",), "customer", ("c_custkey",), "SET_NULL")]).select("issue", "n_bad"), "SELECT 'cascade_restrict' AS issue, count(*) FILTER (WHERE customer NOT IN (SELECT c_custkey FROM customer)) AS n_bad FROM {children} UNION ALL SELECT 'cascade_set_null', count(*) FILTER (WHERE customer IS NULL) FROM {children} UNION ALL SELECT 'conflicting_actions', 1"),
    ("find_orphans", lambda t: referential.orphans(t["children"], ["customer"], t["customer"], ["c_custkey"]).select("id", "customer"), "SELECT id, customer FROM {children} WHERE customer IS NOT NULL AND customer NOT IN (SELECT c_custkey FROM customer)"),
    # circles and chains of more than 64 ancestors are -1
    ("hierarchy_depths", lambda t: referential.ancestors(t["tree"], "id", "parent", 64), "WITH RECURSIVE n AS (SELECT id, parent FROM {tree}), w AS (SELECT id, parent AS up, 0 AS d FROM n UNION ALL SELECT w.id, n.parent, w.d + 1 FROM w JOIN n ON w.up = n.id WHERE w.d < 65) SELECT id::VARCHAR AS id, CASE WHEN max(d) > 64 THEN -1 ELSE max(d) END::BIGINT AS depth FROM w GROUP BY id"),
    # relational helpers and engine primitives
    ("aggregate_lazy", lambda t: _r(relational.aggregate(t["orders"], ["o_orderstatus"], SPEC), 2), "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM orders GROUP BY 1"),
    ("aggregate_all_functions", lambda t: _r(relational.aggregate(t["children"], ["status"], {f: (f, "price") for f in ("sum", "mean", "min", "max", "count", "std", "var", "median", "n_unique", "null_count")}).select("status", F.round("sum", 2).alias("sum"), "mean", "min", "max", "count", "std", F.round(F.col("var") / 1e6, 2).alias("var"), "median", "n_unique", "null_count"), 2), "SELECT status, round(sum(price), 2) AS sum, round(avg(price), 2) AS mean, min(price) AS min, max(price) AS max, count(price) AS count, round(stddev_samp(price), 2) AS std, round(var_samp(price) / 1e6, 2) AS var, round(quantile_cont(price, 0.5), 2) AS median, count(DISTINCT price) AS n_unique, count(*) - count(price) AS null_count FROM {children} GROUP BY 1"),
    ("aggregate_with_join", lambda t: _r(relational.aggregate_with_join(t["customer"].select("c_custkey", "c_name"), t["orders"], "c_custkey", "o_custkey", {"n": ("count", "*"), "total": ("sum", "o_totalprice")}), 2), "SELECT c_custkey, c_name, n, round(total, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey"),
    ("compare_aggregates", lambda t: _r(relational.compare_aggregates(t["lineitem"].withColumnRenamed("l_orderkey", "o_orderkey"), t["orders"].select("o_orderkey", "o_totalprice"), "o_orderkey", "l_extendedprice", "o_totalprice", 100000.0), 2), "SELECT o_orderkey, o_totalprice, round(coalesce(s, 0), 2) AS expected FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - coalesce(s, 0)) > 100000"),
    ("incremental_aggregate", lambda t: _r(relational.incremental_aggregate(t["baseline"].groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("o_totalprice"), F.count("*").alias("n")), t["orders"].where("o_orderkey % 2 = 1"), ["o_orderstatus"], ["o_totalprice"], "n"), 2), "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice, count(*)::BIGINT AS n FROM orders GROUP BY 1"),
    ("window_aggregate", lambda t: _r(relational.window_aggregate(t["orders"].select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], {"running": ("sum", "o_totalprice")}, ["o_orderkey"]), 2), "SELECT o_orderkey, o_custkey, o_totalprice, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders"),
    ("semi_join_filter", lambda t: relational.semi_join_filter(t["customer"].select(F.col("c_custkey").alias("k")), t["orders"].where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")), "k"), "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)"),
    ("anti_join_filter", lambda t: relational.semi_join_filter(t["customer"].select(F.col("c_custkey").alias("k")), t["orders"].where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")), "k", anti=True), "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)"),
    ("multi_table_aggregate", lambda t: _r(relational.multi_table_aggregate({n: t[n] for n in ("orders", "customer", "nation", "region")}, [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey")], ["r_name"], SPEC), 2), "SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    ("rollup", lambda t: relational.group_sets(t["lineitem"], ["l_returnflag", "l_linestatus"], {"n": ("count", "*")}), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"),
    ("cube", lambda t: relational.group_sets(t["lineitem"], ["l_returnflag", "l_linestatus"], {"n": ("count", "*")}, "cube"), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    ("grouping_sets", lambda t: t.spark.sql("SELECT l_returnflag, l_linestatus, count(*) AS n FROM {l} GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", l=t["lineitem"]), "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())"),
    ("top_k", lambda t: relational.top_k(t["orders"], ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_orderstatus", "o_orderkey", "place"), "SELECT o_orderstatus, o_orderkey, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3"),
    ("count_matching", lambda t: relational.matching(t["orders"], "o_totalprice > 100000 and o_orderstatus = 'F'"), "SELECT count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'F') AS n FROM orders"),
    ("count_matching_regex", lambda t: relational.matching(t["people"], "email rlike '9@'"), "SELECT count(*) FILTER (WHERE email LIKE '%9@%') AS n FROM {people}"),
    ("count_not_matching_regex", lambda t: relational.count_not_matching(t["people"], "email", "9@"), "SELECT count(*) FILTER (WHERE email NOT LIKE '%9@%') AS n FROM {people}"),
    ("count_in_range", lambda t: relational.matching(t["people"], "balance between 0 and 1000"), "SELECT count(*) FILTER (WHERE balance BETWEEN 0 AND 1000) AS n FROM {people}"),
    ("count_outside_range", lambda t: relational.count_outside_range(t["people"], "balance", 0, 1000), "SELECT count(*) - count(*) FILTER (WHERE balance BETWEEN 0 AND 1000) AS n FROM {people}"),
    ("count_in_set", lambda t: relational.matching(t["people"], "segment in ('BUILDING', 'N/A')"), "SELECT count(*) FILTER (WHERE segment IN ('BUILDING', 'N/A')) AS n FROM {people}"),
    ("count_duplicates", lambda t: uniqueness.count_duplicates(t["lineitem"], ["l_orderkey", "l_linenumber"]), "SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)))::BIGINT AS surplus, count(*)::BIGINT AS n_rows FROM lineitem"),
    ("get_duplicate_values", lambda t: uniqueness.duplicate_values(t["lineitem"], ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY n DESC, 1, 2 LIMIT 10"),
    ("get_value_counts", lambda t: t["people"].groupBy("segment").count(), "SELECT segment, count(*) AS count FROM {people} GROUP BY 1"),
    ("get_distinct_values", lambda t: t["people"].select("segment").distinct(), "SELECT DISTINCT segment FROM {people}"),
    ("get_column_values", lambda t: relational.value_page(t["orders"], "o_orderkey", ["o_orderkey"], 20, 40), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40"),
    ("get_quantiles", lambda t: _r(relational.quantiles(t["orders"], "o_totalprice", [0.1, 0.5, 0.9])), "SELECT q, round(CASE q WHEN 0.1 THEN quantile_cont(o_totalprice, 0.1) WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5) ELSE quantile_cont(o_totalprice, 0.9) END, 4) AS value FROM orders, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS v(q) GROUP BY q"),
    ("count_nulls_all", lambda t: t["people"].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("balance", "name", "consent")]), "SELECT count(*) - count(balance) AS balance, count(*) - count(name) AS name, count(*) - count(consent) AS consent FROM {people}"),
    ("data_quality_report", lambda t: _r(relational.quality_report(t["children"])), "SELECT round((count(id) + count(customer) + count(price) + count(status))::DOUBLE / (4 * count(*)), 4) AS completeness, round((count(DISTINCT id) + count(DISTINCT customer) + count(DISTINCT price) + count(DISTINCT status))::DOUBLE / (4 * count(*)), 4) AS uniqueness, round(((count(id) + count(customer) + count(price) + count(status))::DOUBLE / (4 * count(*)) + (count(DISTINCT id) + count(DISTINCT customer) + count(DISTINCT price) + count(DISTINCT status))::DOUBLE / (4 * count(*))) / 2, 4) AS overall FROM {children}"),
    ("check_partition_skew", lambda t: relational.partition_skew(t["lineitem"].repartition(8, "l_orderkey")).select("skewed"), "SELECT false AS skewed"),
    ("skewness_kurtosis", lambda t: _r(t["events"].agg(F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))), "SELECT round(avg(pow(value - m, 3)) / pow(max(s), 3), 4) AS skewness, round(avg(pow(value - m, 4)) / pow(max(s), 4) - 3, 4) AS kurtosis FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)"),
    ("incremental_covariance", _matrix, "SELECT count(*) AS n, round(covar_samp(l_quantity, l_extendedprice), 2) AS covariance, round(avg(l_quantity), 4) AS mean FROM lineitem"),
    ("sql_joins", lambda t: t.spark.sql("SELECT n_name, r_name FROM {n} FULL JOIN {r} ON n_regionkey = r_regionkey AND n_nationkey < 10", n=t["nation"], r=t["region"]), "SELECT n_name, r_name FROM nation FULL JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 10"),
    ("sql_set_operations", lambda t: t.spark.sql("(SELECT o_custkey AS k FROM {o} INTERSECT SELECT c_custkey FROM {c}) EXCEPT SELECT o_custkey FROM {o} WHERE o_totalprice > 300000", o=t["orders"], c=t["customer"]), "(SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer) EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000"),
    ("sql_subqueries", lambda t: t.spark.sql("WITH big AS (SELECT * FROM {o} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {o})) SELECT c_mktsegment, count(*) AS n FROM {c} WHERE EXISTS (SELECT 1 FROM big WHERE o_custkey = c_custkey) GROUP BY 1 HAVING count(*) > 1", o=t["orders"], c=t["customer"]), "WITH big AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)) SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM big WHERE o_custkey = c_custkey) GROUP BY 1 HAVING count(*) > 1"),
    ("sql_windows", lambda t: t.spark.sql("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent FROM {o}", o=t["orders"]), "SELECT o_orderkey, (rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC))::INT AS r, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent FROM orders"),
    # geography
    ("points_within_radius", lambda t: _r(geo.within_radius(_points(t), "lat", "lon", (0.0, 0.0), 1500.0).select("id", "distance"), 3), f"SELECT id, round(d, 3) AS distance FROM (SELECT id, {KM.format(a='lat', b='0', c='lon', d='0')} AS d FROM {{places}} WHERE abs(lat) <= 90 AND abs(lon) <= 180) WHERE d <= 1500"),
    # the query set: places whose id is divisible by 50; all places are points
    ("nearest_point", lambda t: _r(geo.nearest(t["places"].where("id % 50 = 0 AND abs(lat) <= 90 AND abs(lon) <= 180").select("id", "lat", "lon"), t["places"].where("abs(lat) <= 90 AND abs(lon) <= 180").select(F.col("id").alias("pid"), "lat", "lon"), "id", "pid", "lat", "lon", 2000.0, 2), 3), f"SELECT id, pid, round(d, 3) AS distance, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, pid) AS place FROM (SELECT a.id, b.id AS pid, {KM.format(a='a.lat', b='b.lat', c='a.lon', d='b.lon')} AS d FROM (SELECT * FROM {{places}} WHERE id % 50 = 0 AND abs(lat) <= 90 AND abs(lon) <= 180) a, (SELECT * FROM {{places}} WHERE abs(lat) <= 90 AND abs(lon) <= 180) b) WHERE d <= 2000) WHERE place <= 2"),
    ("bearing", lambda t: _r(_points(t).select("id", geo.bearing(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("angle")), 3), "SELECT id, round(((degrees(atan2(sin(radians(lon2 - lon)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(lon2 - lon)))) + 360) % 360), 3) AS angle FROM {places} WHERE abs(lat) <= 90 AND abs(lon) <= 180"),
    ("destination_point", lambda t: _points(t).select("id", geo.destination(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(100.0)).alias("d")).select("id", F.round("d.lat", 3).alias("lat")), "SELECT id, round(degrees(asin(sin(radians(lat)) * cos(100 / 6371.0) + cos(radians(lat)) * sin(100 / 6371.0) * cos(radians(45.0)))), 3) AS lat FROM {places} WHERE abs(lat) <= 90 AND abs(lon) <= 180"),
    # profiling
    ("pattern_analyzer", lambda t: _r(profile.patterns(t["people"].select("email", "day", "uuid", "ip_address"))), "SELECT 'email' AS column_name, 'email' AS pattern, round(count(*) FILTER (WHERE email LIKE '%@%')::DOUBLE / count(*), 4) AS share FROM {people} UNION ALL SELECT 'day', 'date', 1.0 UNION ALL SELECT 'day', 'code', 1.0 FROM {people} WHERE id = 1 UNION ALL SELECT 'ip_address', 'ipv4', round(count(*) FILTER (WHERE ip_address NOT LIKE '%.256')::DOUBLE / count(*), 4) FROM {people}"),
    ("cardinality_types", lambda t: profile.semantic_types(t["orders"]), " UNION ALL ".join(f"SELECT '{c}' AS column_name, CASE WHEN count(DISTINCT {c})::DOUBLE / count({c}) >= 0.95 THEN 'identifier' WHEN count(DISTINCT {c})::DOUBLE / count({c}) <= 0.05 THEN 'categorical' ELSE 'plain' END AS semantic FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))),
    ("top_values", lambda t: _r(profiling.top_values(t["people"], "segment", 3)), "SELECT segment, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM {people}), 4) AS p FROM {people} GROUP BY 1 ORDER BY n DESC, segment LIMIT 3"),
    ("duplicate_row_analyzer", lambda t: profile.duplicate_rows(t["lineitem"].select("l_orderkey", "l_linenumber")), "SELECT count(*)::BIGINT AS n_rows, (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)))::BIGINT AS n_duplicate FROM lineitem"),
    ("correlation_analyzer", lambda t: _r(profile.correlations(t["lineitem"].select("l_quantity", "l_extendedprice"), 0.0)), "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 4) AS r FROM lineitem"),
    ("profile_comparator", lambda t: _r(profile.compare_profiles(profile.profile(t["baseline"], ["o_totalprice"]), profile.profile(t["shifted"], ["o_totalprice"])), 2), ""),
    ("functional_dependencies", lambda t: _r(profile.functional_dependencies(t["lineitem"], [("l_partkey", "l_returnflag"), ("l_orderkey", "l_orderkey")], 0.0)), "SELECT 'l_partkey' AS determinant, 'l_returnflag' AS dependent, round(avg((k = 1)::INT), 4) AS confidence FROM (SELECT count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY l_partkey) UNION ALL SELECT 'l_orderkey', 'l_orderkey', 1.0"),
    ("conditional_rules", lambda t: _r(profile.conditional_rules(t["lineitem"], "l_returnflag", "l_linestatus", 10, 0.4)), "SELECT l_returnflag AS if_value, l_linestatus AS then_value, n AS support, round(n::DOUBLE / t, 4) AS confidence FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2) JOIN (SELECT l_returnflag, count(*) AS t FROM lineitem GROUP BY 1) USING (l_returnflag) WHERE n >= 10 AND n::DOUBLE / t >= 0.4"),
    ("mutual_information", lambda t: _r(ml_feature.mutual_information(t["lineitem"], "l_quantity", "l_extendedprice")), MUTUAL),
    ("hyperloglog_merge", lambda t: t["orders"].groupBy("o_orderstatus").agg(F.hll_sketch_agg("o_orderpriority", 12).alias("s")).agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("n")), "SELECT count(DISTINCT o_orderpriority) AS n FROM orders"),
    # streams, over a batch
    ("tumbling_window", lambda t: _r(windows.tumbling(t["events"], "ts", "1 hour", WINDOW_SPEC), 8), f"SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, {TOTALS} FROM events GROUP BY 1, 2"),
    ("tumbling_window_keyed", lambda t: _r(windows.tumbling(t["events"], "ts", "1 day", WINDOW_SPEC, ["event_type"]), 8), f"SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, {TOTALS} FROM events GROUP BY 1, 2, 3"),
    ("sliding_window", lambda t: _r(windows.sliding(t["events"], "ts", "2 hours", "1 hour", WINDOW_SPEC), 8), f"SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, {TOTALS} FROM (SELECT date_trunc('hour', ts) - k * INTERVAL 1 HOUR AS s, value FROM events, (VALUES (0), (1)) AS v(k)) GROUP BY s"),
    ("session_window", lambda t: _r(windows.session(t["events"], "ts", "30 minutes", {"n": ("count", "*"), "total": ("sum", "value")}, ["user_id"])), "SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"),
    ("deduplicate", lambda t: windows.deduplicated(t["lineitem"].select("l_orderkey", "l_linenumber"), "x", ["l_orderkey", "l_linenumber"]), "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem"),
    ("content_hash", lambda t: t["nation"].withColumn("h", windows.by_content(t["nation"])).select(F.count_distinct("h").alias("n")), "SELECT count(*) AS n FROM nation"),
    ("interval_join", lambda t: windows.joined_within(t["events"].where("event_type = 'click'").selectExpr("user_id", "ts", "event_id AS a"), t["events"].where("event_type = 'purchase'").selectExpr("user_id", "ts AS ts2", "event_id AS b"), "user_id", "ts", "ts2", "2 HOURS").selectExpr("a.a AS a", "b.b AS b"), "SELECT x.event_id AS a, y.event_id AS b FROM events x JOIN events y ON x.user_id = y.user_id AND x.event_type = 'click' AND y.event_type = 'purchase' AND y.ts BETWEEN x.ts - INTERVAL 2 HOUR AND x.ts + INTERVAL 2 HOUR"),
    # models
    ("ml_zscore", lambda t: detectors.flagged(detectors.ZScore("value", 2.0), t["events"], "event_id"), "SELECT event_id FROM events WHERE abs(value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) > 2.0"),
    ("ml_iqr", lambda t: detectors.flagged(detectors.Iqr("value", 1.5), t["events"], "event_id"), "SELECT event_id FROM events WHERE value > (SELECT quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events) OR value < (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM events)"),
    ("ml_mad", lambda t: detectors.flagged(detectors.Mad("value", 3.5), t["events"], "event_id"), "SELECT event_id FROM events, (SELECT quantile_cont(value, 0.5) AS m FROM events), (SELECT quantile_cont(abs(value - m), 0.5) AS d FROM events, (SELECT quantile_cont(value, 0.5) AS m FROM events)) WHERE 0.6745 * abs(value - m) / d > 3.5"),
    ("ml_isolation_forest", lambda t: detectors.flagged(detectors.IsolationForest(["l_quantity", "l_extendedprice"]), t["lineitem"].withColumn("id", F.xxhash64(*t["lineitem"].columns)), "id"), ""),
    ("ml_ensemble", lambda t: detectors.flagged(detectors.Ensemble([detectors.ZScore("value", 2.0), detectors.Iqr("value", 1.5)], "vote"), t["events"], "event_id"), ""),
    ("ml_concept_drift", lambda t: detectors.concept_drift(t["events"].selectExpr("date_trunc('day', ts) AS part", "event_id AS seq", "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error"), "part", "seq", "error"), ""),
    ("ml_multivariate_drift", lambda t: _r(detectors.correlation_drift(t["baseline"].selectExpr("o_totalprice AS x", "double(o_custkey) AS y"), t["shifted"].selectExpr("o_totalprice AS x", "double(o_custkey) AS y"), ["x", "y"])), "SELECT round(abs((SELECT corr(o_totalprice, o_custkey) FROM {baseline}) - (SELECT corr(o_totalprice, o_custkey) FROM {shifted})), 4) AS drift"),
    ("ml_local_outlier_factor", lambda t: detectors.local_outlier_factor(t["embeddings"].select("vec_id", "embedding"), "vec_id", "embedding", 5), ""),
    ("autocorrelation", lambda t: _r(timeseries.autocorrelation(timeseries._series(t["daily"], "ts", "value"), [1, 7])), ""),
]
