"""Registered checks: name, source, the check, and its results in SQL: (check, column, issue, bad, total, actual) of each row, with the limit and scale if they aren't the usual ones."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..operators import (
    aggregate, anomaly, business, completeness, cross_table, dates, distribution, drift, geospatial, ml_feature, multi_column, privacy, profiling, referential, schemas, strings, timeseries, uniqueness,
)
from ..operators import queries as q
from ..streaming import windows
from . import sdk
from .checks import DUPLICATES, RANGES, STRICT

NOW = datetime(2024, 1, 31)
SQL_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
ONE = "1"
TEN = {"grade": (0.1, 0.05, 0.01), "at_least": True}
HIGH, MEDIUM = {"grade": "high"}, {"grade": "medium"}


def _if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def _out(value: str, low: float | None = None, high: float | None = None) -> str:
    parts = ([f"{value} < {low}"] if low is not None else []) + ([f"{value} > {high}"] if high is not None else [])
    return f"CASE WHEN {' OR '.join(parts)} THEN 1 ELSE 0 END" if parts else "max(0)"


def _stat(check: str, column: str, issue: str, value: str, low=None, high=None, *grade) -> tuple:
    return (check, column, issue, _out(value, low, high), ONE, value, *grade)


def _fmt(check: str, column: str, pattern: str) -> tuple:
    return (check, column, f"invalid_{check}", _if(f"regexp_matches({column}, '\\S') AND NOT regexp_matches({column}, '{pattern}')"), f"count({column})")


BLANK = "NOT regexp_matches(name, '\\S')"
KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"
DIST = KM.format(a="lat", b="lat2", c="lon", d="lon2")
FROM_SEOUL = KM.format(a="lat", b="37.5", c="lon", d="127.0")
SQUARE = "POLYGON((-50 -30, 60 -30, 60 50, -50 50))"
BOX = "POLYGON((100 -10, 150 -10, 150 40, 100 40))"
IN_SQUARE, IN_BOX = "(lat > -30 AND lat < 50 AND lon > -50 AND lon < 60)", "(lat > -10 AND lat < 40 AND lon > 100 AND lon < 150)"


def _q(column: str, p: float) -> str:
    return f"(SELECT quantile_cont({column}, {p}) FROM {{source}})"


def _fence(column: str, m: float) -> str:
    a, b = _q(column, 0.25), _q(column, 0.75)
    return f"({column} < {a} - {m} * ({b} - {a}) OR {column} > {b} + {m} * ({b} - {a}))"


def _orphan(fk: str = "customer") -> str:
    return _if(f"{fk} IS NOT NULL AND {fk} NOT IN (SELECT c_custkey FROM customer)")


def _entropy(column: str) -> str:
    return f"(SELECT sum(-p * log2(p)) FROM (SELECT count(*)::DOUBLE / (SELECT count({column}) FROM {{source}}) AS p FROM {{source}} WHERE {column} IS NOT NULL GROUP BY {column}))"


DIFFS = "(SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts), ts) / 1e6 AS gap FROM {source} WHERE ts IS NOT NULL)"
SERIES = "(SELECT row_number() OVER (ORDER BY ts, value) - 1 AS i, value AS x FROM {source} WHERE ts IS NOT NULL AND value IS NOT NULL)"

def _drifted(check: str, column: str, issue: str, value: str, threshold: float) -> tuple:
    """A drift row: an issue from the threshold on, high from 1.5 times, critical from twice that."""
    level = f"CASE WHEN actual >= {2 * threshold} THEN 'critical' WHEN actual >= {1.5 * threshold} THEN 'high' ELSE 'medium' END"
    return (check, column, issue, f"CASE WHEN {value} >= {threshold} THEN 1 ELSE max(0) END", ONE, value, level)


def _change(aggregate: str) -> str:
    """Percent by which an aggregate of the price differs from the baseline's."""
    base = f"(SELECT {aggregate} FROM {{baseline}})"
    return f"(abs({aggregate} - {base}) / abs({base}) * 100)"


SHARES = "(SELECT coalesce(a.p, 1e-10) AS p, coalesce(b.p, 1e-10) AS q FROM (SELECT o_orderstatus AS v, count(*)::DOUBLE / (SELECT count(*) FROM {shifted}) AS p FROM {shifted} GROUP BY 1) a FULL JOIN (SELECT o_orderstatus AS v, count(*)::DOUBLE / (SELECT count(*) FROM {baseline}) AS p FROM {baseline} GROUP BY 1) b ON a.v = b.v)"
DEPTHS = "(WITH RECURSIVE n AS (SELECT id, parent FROM {source}), w AS (SELECT id AS start, id, parent AS up, 0 AS d FROM n UNION ALL SELECT w.start, n.id, n.parent, w.d + 1 FROM w JOIN n ON w.up = n.id WHERE w.d < 70) SELECT start, max(d) AS d FROM w GROUP BY start)"
CIRCLE = f"(SELECT count(*) FILTER (WHERE d >= 70) FROM {DEPTHS})"
DEEPEST = f"(SELECT max(d) FILTER (WHERE d < 70) FROM {DEPTHS})"
KL = f"(SELECT sum(p * ln(p / q)) FROM {SHARES})"
BINS = "(SELECT count(*) FILTER (WHERE side = 0)::DOUBLE / (SELECT count(*) FROM {shifted}) + 1e-10 AS p, count(*) FILTER (WHERE side = 1)::DOUBLE / (SELECT count(*) FROM {baseline}) + 1e-10 AS q FROM (SELECT side, least(floor((x - lo) / ((hi - lo) / 10)), 9) AS bin FROM (SELECT o_totalprice AS x, 0 AS side FROM {shifted} UNION ALL SELECT o_totalprice, 1 FROM {baseline}), (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM (SELECT o_totalprice FROM {shifted} UNION ALL SELECT o_totalprice FROM {baseline}))) GROUP BY bin)"
JS = f"(SELECT sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q))) FROM {BINS})"
KS = "(SELECT max(abs(f - g)) FROM (SELECT sum(a) OVER (ORDER BY x)::DOUBLE / (SELECT count(*) FROM {shifted}) AS f, sum(b) OVER (ORDER BY x)::DOUBLE / (SELECT count(*) FROM {baseline}) AS g FROM (SELECT x, sum(a) AS a, sum(b) AS b FROM (SELECT o_totalprice AS x, 1 AS a, 0 AS b FROM {shifted} UNION ALL SELECT o_totalprice, 0, 1 FROM {baseline}) GROUP BY x)))"

CHI2 = "(SELECT sum(pow(a - e, 2) / e) FROM (SELECT n AS a, q * (SELECT count(*) FROM {shifted}) AS e FROM (SELECT o_orderstatus AS v, count(*) AS n FROM {shifted} GROUP BY 1) JOIN (SELECT o_orderstatus AS v, count(*)::DOUBLE / (SELECT count(*) FROM {baseline}) AS q FROM {baseline} GROUP BY 1) USING (v)))"
LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
FLAGSHIP = [
    *[("null", c, "null", _if(f"{c} IS NULL")) for c in LINEITEM],
    *[("not_null", c, "not_null_violation", _if(f"{c} IS NULL"), "count(*)", "NULL", STRICT) for c in LINEITEM],
    ("between", "l_discount", "out_of_range", _if("l_discount < 0 OR l_discount > 0.1"), "count(l_discount)", "NULL", RANGES),
    ("positive", "l_quantity", "not_positive", _if("l_quantity <= 0"), "count(l_quantity)"),
    ("compound_key", "l_orderkey,l_linenumber", "compound_key_duplicate", "(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {source} GROUP BY l_orderkey, l_linenumber))", "count(*)", "NULL", "critical"),
    ("compound_key", "l_orderkey,l_linenumber", "compound_key_null", _if("l_orderkey IS NULL OR l_linenumber IS NULL"), "count(*)", "NULL", "critical"),
]

CHECKS = [
    # completeness
    ("null", "people", lambda t: completeness.null("balance"), [("null", "balance", "null", _if("balance IS NULL"))]),
    ("not_null", "people", lambda t: completeness.not_null("balance"), [("not_null", "balance", "not_null_violation", _if("balance IS NULL"))], {"grade": STRICT}),
    ("not_null_mostly", "people", lambda t: completeness.not_null("balance").with_mostly(0.5), [("not_null", "balance", "not_null_violation", _if("balance IS NULL"))], {"grade": STRICT, "limit": 0.5}),
    ("completeness_ratio", "people", lambda t: completeness.completeness_ratio("balance"), [("completeness_ratio", "balance", "low_completeness", _if("balance IS NULL"), "count(*)", "count(balance)::DOUBLE / count(*)")], {"limit": 0.05}),
    ("conditional_null", "people", lambda t: completeness.conditional_null("balance", "segment", ["N/A"]), [("conditional_null", "balance", "conditional_null", _if("segment IN ('N/A') AND balance IS NULL"), _if("segment IN ('N/A')"))], HIGH),
    ("default_value", "people", lambda t: completeness.default_value("segment"), [("default_value", "segment", "default_value", _if("segment = 'N/A'"))], {"limit": 0.1}),
    ("empty_string", "people", lambda t: completeness.empty_string("name"), [("empty_string", "name", "empty_string", _if("name = ''"))]),
    ("whitespace_only", "people", lambda t: completeness.whitespace_only("name"), [("whitespace_only", "name", "whitespace_only", _if(BLANK))]),
    ("nan", "people", lambda t: completeness.nan("reading"), [("nan", "reading", "nan", _if("isnan(reading)"), "count(reading)")]),
    ("not_nan", "people", lambda t: completeness.not_nan("reading"), [("not_nan", "reading", "nan_violation", _if("isnan(reading)"))], HIGH),
    ("nan_ratio", "people", lambda t: completeness.nan_ratio("reading", 0.01), [("nan_ratio", "reading", "high_nan_ratio", _if("isnan(reading)"), "count(reading)")], {"limit": 0.01}),
    ("infinity", "people", lambda t: completeness.infinity("reading"), [("infinity", "reading", "infinity", _if("isinf(reading)"), "count(reading)")]),
    ("finite", "people", lambda t: completeness.finite("reading"), [("finite", "reading", "non_finite", _if("isnan(reading) OR isinf(reading)"))], HIGH),
    # uniqueness
    ("unique", "children", lambda t: uniqueness.unique("customer"), [("unique", "customer", "unique_violation", "count(customer) - count(DISTINCT customer)", "count(customer)")]),
    ("unique_null_as_value", "children", lambda t: uniqueness.unique("customer", True), [("unique", "customer", "unique_violation", "count(customer) - count(DISTINCT customer) - 1", "count(customer)")]),
    ("unique_ratio", "children", lambda t: uniqueness.unique_ratio("customer", 0.5), [_stat("unique_ratio", "customer", "unique_ratio_out_of_range", "count(DISTINCT customer)::DOUBLE / count(customer)", 0.5)], MEDIUM),
    ("distinct_count", "people", lambda t: uniqueness.distinct_count("segment", 1, 3), [_stat("distinct_count", "segment", "distinct_count_out_of_range", "count(DISTINCT segment)", 1, 3)], MEDIUM),
    ("distinct_count_between", "children", lambda t: uniqueness.distinct_count_between("status", 1, 2), [_stat("distinct_count_between", "status", "distinct_count_out_of_range", "count(DISTINCT status)", 1, 2)], MEDIUM),
    ("approximate_distinct_count", "people", lambda t: uniqueness.approximate_distinct_count("segment", 1, 3), [_stat("approximate_distinct_count", "segment", "distinct_count_out_of_range", "count(DISTINCT segment)", 1, 3)], MEDIUM),
    ("approximate_unique_ratio", "orders", lambda t: uniqueness.approximate_unique_ratio("o_orderstatus", 0.5), [_stat("approximate_unique_ratio", "o_orderstatus", "unique_ratio_out_of_range", "count(DISTINCT o_orderstatus)::DOUBLE / count(*)", 0.5)], MEDIUM),
    ("streaming_distinct_count", "people", lambda t: uniqueness.streaming_distinct_count("segment", 1, 3), [_stat("streaming_distinct_count", "segment", "distinct_count_out_of_range", "count(DISTINCT segment)", 1, 3)], MEDIUM),
    ("distinct_values_in_set", "people", lambda t: uniqueness.distinct_values_in_set("segment", ["BUILDING", "MACHINERY"]), [("distinct_values_in_set", "segment", "unexpected_value", "count(DISTINCT segment) FILTER (WHERE segment NOT IN ('BUILDING', 'MACHINERY'))", "count(DISTINCT segment)")]),
    ("distinct_values_equal_set", "people", lambda t: uniqueness.distinct_values_equal_set("segment", ["BUILDING", "NONE"]), [("distinct_values_equal_set", "segment", "unexpected_value", "count(DISTINCT segment) FILTER (WHERE segment NOT IN ('BUILDING', 'NONE'))", "count(DISTINCT segment)"), ("distinct_values_equal_set", "segment", "missing_value", "2 - count(DISTINCT segment) FILTER (WHERE segment IN ('BUILDING', 'NONE'))", "2")]),
    ("distinct_values_contain_set", "people", lambda t: uniqueness.distinct_values_contain_set("segment", ["BUILDING", "NONE"]), [("distinct_values_contain_set", "segment", "missing_value", "2 - count(DISTINCT segment) FILTER (WHERE segment IN ('BUILDING', 'NONE'))", "2")]),
    ("duplicate", "lineitem", lambda t: uniqueness.duplicate(["l_orderkey", "l_linenumber"]), [("duplicate", "l_orderkey,l_linenumber", "duplicate_row", "(SELECT sum(n) FROM (SELECT count(*) AS n FROM {source} GROUP BY l_orderkey, l_linenumber) WHERE n > 1)")], {"grade": DUPLICATES}),
    ("duplicate_within_group", "lineitem", lambda t: uniqueness.duplicate_within_group(["l_orderkey"], "l_linenumber"), [("duplicate_within_group", "l_linenumber", "duplicate_within_group", "(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {source} GROUP BY l_orderkey, l_linenumber))")], {"grade": DUPLICATES}),
    ("primary_key", "children", lambda t: uniqueness.primary_key("customer"), [("primary_key", "customer", "primary_key_null", _if("customer IS NULL")), ("primary_key", "customer", "primary_key_duplicate", "count(customer) - count(DISTINCT customer)", "count(customer)")], {"grade": "critical"}),
    ("compound_key", "rows3", lambda t: uniqueness.compound_key(["a", "flag2"]), [("compound_key", "a,flag2", "compound_key_duplicate", "(SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM {source} GROUP BY a, flag2))"), ("compound_key", "a,flag2", "compound_key_null", _if("a IS NULL OR flag2 IS NULL"))], {"grade": "critical"}),
    ("unique_within_record", "rows3", lambda t: uniqueness.unique_within_record(["line", "c", "b"]), [("unique_within_record", "line,c,b", "repeated_within_record", _if("line = c OR line = b OR b = c"))]),
    ("all_columns_unique_within_record", "nation", lambda t: uniqueness.all_columns_unique_within_record(), [("all_columns_unique_within_record", "numeric", "repeated_within_record", _if("n_nationkey = n_regionkey"))]),
    ("column_pair_unique", "rows3", lambda t: uniqueness.column_pair_unique("flag", "flag2"), [("column_pair_unique", "flag,flag2", "equal_pair", _if("flag = flag2"))]),
    # aggregate
    ("mean_between", "orders", lambda t: aggregate.mean_between("o_totalprice", 0, 1000), [_stat("mean_between", "o_totalprice", "mean_out_of_range", "avg(o_totalprice)", 0, 1000)], MEDIUM),
    ("median_between", "orders", lambda t: aggregate.median_between("o_totalprice", 0, 1000), [_stat("median_between", "o_totalprice", "median_out_of_range", "quantile_cont(o_totalprice, 0.5)", 0, 1000)], MEDIUM),
    ("min_between", "orders", lambda t: aggregate.min_between("o_totalprice", 0), [_stat("min_between", "o_totalprice", "min_out_of_range", "min(o_totalprice)", 0)], MEDIUM),
    ("max_between", "orders", lambda t: aggregate.max_between("o_totalprice", None, 1000), [_stat("max_between", "o_totalprice", "max_out_of_range", "max(o_totalprice)", None, 1000)], MEDIUM),
    ("std_between", "orders", lambda t: aggregate.std_between("o_totalprice", 0, 1000), [_stat("std_between", "o_totalprice", "std_out_of_range", "stddev_samp(o_totalprice)", 0, 1000)], MEDIUM),
    ("variance_between", "lineitem", lambda t: aggregate.variance_between("l_quantity", 0, 10), [_stat("variance_between", "l_quantity", "variance_out_of_range", "var_samp(l_quantity)", 0, 10)], MEDIUM),
    ("sum_between", "lineitem", lambda t: aggregate.sum_between("l_quantity", 0, 10), [_stat("sum_between", "l_quantity", "sum_out_of_range", "sum(l_quantity)", 0, 10)], MEDIUM),
    ("type", "people", lambda t: aggregate.mixed_type("mixed"), [("type", "mixed", "mixed_type", "least(count(*) FILTER (WHERE mixed = '42'), count(*) FILTER (WHERE mixed <> '42'))")]),
    # distribution
    ("distribution", "shifted", lambda t: distribution.distribution("o_totalprice", t["baseline"], 0.01), [("distribution", "o_totalprice", "distribution_shift", f"CASE WHEN {JS} > 0.01 THEN 1 ELSE max(0) END", ONE, JS)], MEDIUM),
    ("increasing", "events", lambda t: distribution.increasing("value", ["ts"]), [("increasing", "value", "not_increasing", "(SELECT count(*) FILTER (WHERE value < p) FROM (SELECT value, lag(value) OVER (ORDER BY ts) AS p FROM {source}))")]),
    ("decreasing", "events", lambda t: distribution.decreasing("value", ["ts"], True), [("decreasing", "value", "not_decreasing", "(SELECT count(*) FILTER (WHERE value >= p) FROM (SELECT value, lag(value) OVER (ORDER BY ts) AS p FROM {source}))")]),
    ("outlier", "events", lambda t: distribution.outlier("value"), [("outlier", "value", "outlier", _if(_fence("value", 1.5)), "count(value)")]),
    ("zscore_outlier", "events", lambda t: distribution.zscore_outlier("value", 2.0), [("zscore_outlier", "value", "zscore_outlier", _if("abs(value - (SELECT avg(value) FROM {source})) > 2.0 * (SELECT stddev_samp(value) FROM {source})"), "count(value)")]),
    ("quantile", "orders", lambda t: distribution.quantile("o_totalprice", 0.9, 0, 1000), [_stat("quantile", "o_totalprice", "quantile_out_of_range", "quantile_cont(o_totalprice, 0.9)", 0, 1000)], MEDIUM),
    ("between", "lineitem", lambda t: distribution.between("l_discount", 0.02, 0.08), [("between", "l_discount", "out_of_range", _if("l_discount < 0.02 OR l_discount > 0.08"), "count(l_discount)")], {"grade": RANGES}),
    ("between_exclusive", "lineitem", lambda t: distribution.between("l_quantity", 1, 50, False), [("between", "l_quantity", "out_of_range", _if("l_quantity <= 1 OR l_quantity >= 50"), "count(l_quantity)")], {"grade": RANGES}),
    ("range", "people", lambda t: distribution.named_range("age"), [("range", "age", "out_of_range", _if("age < 0 OR age > 150"), "count(age)")], {"grade": RANGES}),
    ("positive", "people", lambda t: distribution.positive("age"), [("positive", "age", "not_positive", _if("age <= 0"), "count(age)")]),
    ("non_negative", "people", lambda t: distribution.non_negative("age"), [("non_negative", "age", "negative", _if("age < 0"), "count(age)")]),
    ("in_set", "people", lambda t: distribution.in_set("segment", ["BUILDING", "MACHINERY"]), [("in_set", "segment", "not_in_set", _if("segment NOT IN ('BUILDING', 'MACHINERY')"), "count(segment)")]),
    ("not_in_set", "people", lambda t: distribution.not_in_set("segment", ["N/A"]), [("not_in_set", "segment", "forbidden_value", _if("segment IN ('N/A')"), "count(segment)")], HIGH),
    ("kl_divergence", "shifted", lambda t: distribution.kl_divergence("o_orderstatus", t["baseline"], 0.001), [("kl_divergence", "o_orderstatus", "distribution_divergence", f"CASE WHEN {KL} > 0.001 THEN 1 ELSE max(0) END", ONE, KL, "CASE WHEN actual > 0.003 THEN 'critical' WHEN actual > 0.002 THEN 'high' ELSE 'medium' END")]),
    ("chi_square", "orders", lambda t: distribution.chi_square("o_orderpriority"), [("chi_square", "o_orderpriority", "unexpected_distribution", "CASE WHEN (SELECT sum(pow(n - e, 2) / e) FROM (SELECT count(*) AS n, (SELECT count(*) / 5.0 FROM {source}) AS e FROM {source} GROUP BY o_orderpriority)) > 9.4877 THEN 1 ELSE max(0) END", ONE, "(SELECT sum(pow(n - e, 2) / e) FROM (SELECT count(*) AS n, (SELECT count(*) / 5.0 FROM {source}) AS e FROM {source} GROUP BY o_orderpriority))")], MEDIUM),
    ("most_common_value", "people", lambda t: distribution.most_common_value("segment", ["BUILDING"]), [("most_common_value", "segment", "unexpected_common_value", "CASE WHEN (SELECT segment FROM {source} GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1) <> 'BUILDING' THEN 1 ELSE max(0) END", ONE)], MEDIUM),
    # string
    ("email", "people", lambda t: strings.email("email"), [_fmt("email", "email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z")]),
    ("url", "people", lambda t: strings.url("url"), [_fmt("url", "url", r"(?i)^https?://[^\s/$.?#].[^\s]*\z")]),
    ("phone", "people", lambda t: strings.phone("phone", "generic"), [_fmt("phone", "phone", r"^[+]?[(]?[0-9]{1,4}[)]?[-\s./0-9]{5,20}\z")]),
    ("uuid", "people", lambda t: strings.uuid("uuid"), [_fmt("uuid", "uuid", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")]),
    ("ip_address", "people", lambda t: strings.ip_address("ip_address"), [_fmt("ip_address", "ip_address", r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\z")]),
    ("ipv6_address", "people", lambda t: strings.ipv6_address("ip6"), [("ipv6_address", "ip6", "invalid_ipv6_address", _if("ip6 LIKE '%zz%'"), "count(ip6)")]),
    ("format", "people", lambda t: strings.named_format(["email", "uuid"]), [("format", "email", "invalid_format", _if("email NOT LIKE '%@%.%' AND email <> ''")), ("format", "uuid", "invalid_format", _if("length(uuid) <> 36"))]),
    ("consistent_casing", "people", lambda t: strings.consistent_casing("segment", "upper"), [("consistent_casing", "segment", "inconsistent_casing", _if("segment <> upper(segment)"), "count(segment)")]),
    ("alphanumeric", "people", lambda t: strings.alphanumeric("name", allow_space=True), [("alphanumeric", "name", "non_alphanumeric", _if(r"NOT regexp_matches(name, '^[a-zA-Z0-9\s]*\z')"), "count(name)")]),
    ("json_parseable", "people", lambda t: strings.json_parseable("mixed"), [("json_parseable", "mixed", "invalid_json", _if("NOT json_valid(mixed)"), "count(mixed)")]),
    ("json_schema", "events", lambda t: strings.json_schema("props", {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}}), [("json_schema", "props", "json_schema_violation", _if("(props->>'k')::INT > 50"), "count(props)")]),
    ("length", "people", lambda t: strings.length("name", 4, 18), [("length", "name", "invalid_length", _if("length(name) < 4 OR length(name) > 18"))]),
    ("like_pattern", "people", lambda t: strings.like_pattern("Customer#%", "name"), [("like_pattern", "name", "like_mismatch", _if("name NOT LIKE 'Customer#%'"), "count(name)")]),
    ("not_like_pattern", "people", lambda t: strings.not_like_pattern("%0000007%", "name"), [("not_like_pattern", "name", "like_match", _if("name LIKE '%0000007%'"), "count(name)")]),
    ("regex", "people", lambda t: strings.regex(r"Customer#\d+[0-4]", "name"), [("regex", "name", "regex_mismatch", _if(r"regexp_matches(name, '\S') AND NOT regexp_full_match(name, 'Customer#\d+[0-4]')"), "count(name)")]),
    ("regex_list", "people", lambda t: strings.regex_list([r"Customer#\d+[0-4]", r"\s*"], "name"), [("regex_list", "name", "regex_list_mismatch", _if(r"NOT (regexp_full_match(name, 'Customer#\d+[0-4]') OR regexp_full_match(name, '\s*'))"), "count(name)")]),
    ("not_match_regex", "people", lambda t: strings.not_match_regex(r"77", "name"), [("not_match_regex", "name", "forbidden_pattern", _if("regexp_matches(name, '77')"), "count(name)")]),
    ("not_match_regex_list", "people", lambda t: strings.not_match_regex_list(["77", "CUSTOMER#0000001"], "name"), [("not_match_regex_list", "name", "forbidden_pattern", _if("regexp_matches(name, '(?i)77|customer#0000001')"), "count(name)")]),
    # datetime
    ("date_format", "people", lambda t: dates.date_format("day"), [("date_format", "day", "invalid_date_format", _if("try_strptime(day, '%Y-%m-%d') IS NULL"), "count(day)")]),
    ("recent_data", "events", lambda t: dates.recent_data("ts", 1.0, NOW), [("recent_data", "ts", "stale_data", f"CASE WHEN date_diff('microsecond', max(ts), {SQL_NOW}) / 3.6e9 > 1 THEN 1 ELSE 0 END", ONE, f"date_diff('microsecond', max(ts), {SQL_NOW}) / 3.6e9", "CASE WHEN actual > 2 THEN 'critical' ELSE 'high' END")]),
    ("date_part_coverage", "events", lambda t: dates.date_part_coverage("ts", "hour"), [("date_part_coverage", "ts", "incomplete_coverage", "CASE WHEN count(DISTINCT date_trunc('hour', ts))::DOUBLE / (date_diff('hour', min(ts), max(ts)) + 1) < 1 THEN 1 ELSE 0 END", ONE, "count(DISTINCT date_trunc('hour', ts))::DOUBLE / (date_diff('hour', min(ts), max(ts)) + 1)")], MEDIUM),
    ("grouped_recent_data", "events", lambda t: dates.grouped_recent_data("ts", "user_id", 24.0, datetime(2024, 1, 30)), [("grouped_recent_data", "user_id", "stale_group", "(SELECT count(*) FILTER (WHERE m IS NULL OR m < TIMESTAMP '2024-01-29') FROM (SELECT max(ts) AS m FROM {source} GROUP BY user_id))", "count(DISTINCT user_id)")]),
    ("date_order", "orders", lambda t: sdk.composite("date_order_pair", [dates.date_order("o_orderdate", "o_orderdate", False)]), [("date_order_pair", "o_orderdate,o_orderdate", "invalid_date_order", "count(o_orderdate)")]),
    ("dateutil_parseable", "people", lambda t: dates.dateutil_parseable("day"), [("dateutil_parseable", "day", "unparseable_date", _if("day = '2024-13-01'"), "count(day)")]),
    ("date_between", "orders", lambda t: dates.date_between("o_orderdate", "1995-01-01", "1998-01-01"), [("date_between", "o_orderdate", "date_out_of_range", _if("o_orderdate::DATE < DATE '1995-01-01' OR o_orderdate::DATE > DATE '1998-01-01'"), "count(o_orderdate)")]),
    ("future_date", "events", lambda t: dates.future_date("ts", datetime(2024, 1, 10)), [("future_date", "ts", "future_date", _if("ts::DATE > DATE '2024-01-10'"), "count(ts)")]),
    ("past_date", "orders", lambda t: dates.past_date("o_orderdate", "1996-01-01"), [("past_date", "o_orderdate", "date_too_old", _if("o_orderdate::DATE < DATE '1996-01-01'"), "count(o_orderdate)")]),
    ("timezone", "events", lambda t: dates.timezone("ts", "Asia/Seoul"), [("timezone", "ts", "missing_timezone", "max(1)", ONE)], MEDIUM),
    # schema and table
    ("column_count", "nation", lambda t: schemas.column_count(exact_count=4), [("column_count", "*", "column_count", "max(1)", ONE)], HIGH),
    ("row_count", "nation", lambda t: schemas.row_count(30), [_stat("row_count", "*", "row_count", "count(*)", 30)], HIGH),
    ("column_exists", "nation", lambda t: schemas.column_exists(["n_name", "n_flag"]), [("column_exists", "n_flag", "missing_column", "max(1)", ONE)], {"grade": "critical"}),
    ("column_not_exists", "nation", lambda t: schemas.column_not_exists(["n_name", "n_flag"]), [("column_not_exists", "n_name", "forbidden_column", "max(1)", ONE)], HIGH),
    ("column_order", "nation", lambda t: schemas.column_order(["n_name", "n_nationkey"], False), [("column_order", "*", "column_order", "max(1)", ONE)], MEDIUM),
    ("column_type", "nation", lambda t: schemas.column_type({"n_name": "integer", "n_nationkey": "int"}), [("column_type", "n_name", "type_mismatch", "max(1)", ONE)], HIGH),
    ("column_pair", "rows3", lambda t: schemas.column_pair("a", "b", ">"), [("column_pair", "a,b", "column_pair_violation", _if("NOT a > b"))]),
    ("column_pair_in_set", "rows3", lambda t: schemas.column_pair_in_set("flag", "status", [("A", "F"), ("R", "F"), ("N", "O")]), [("column_pair_in_set", "flag,status", "invalid_pair", _if("(flag || status) NOT IN ('AF', 'RF', 'NO')"))]),
    ("column_pair_not_in_set", "rows3", lambda t: schemas.column_pair_not_in_set("flag", "status", [("A", "O")]), [("column_pair_not_in_set", "flag,status", "forbidden_pair", _if("flag = 'A' AND status = 'O'"))], HIGH),
    ("multi_column_unique", "lineitem", lambda t: schemas.multi_column_unique(["l_orderkey", "l_partkey"]), [("multi_column_unique", "l_orderkey,l_partkey", "duplicate_key", "count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM {source}))")]),
    ("multi_column_sum", "rows3", lambda t: schemas.multi_column_sum(["discount", "tax"], "total", tolerance=0.01), [("multi_column_sum", "discount,tax", "sum_mismatch", _if("a % 10 = 0"))]),
    ("multi_column_calculation", "rows3", lambda t: schemas.multi_column_calculation("discount", "+", "tax", "total"), [("multi_column_calculation", "discount+tax", "calculation_mismatch", _if("a % 10 = 0"))]),
    ("referential_integrity", "children", lambda t: schemas.referential_integrity("customer", t["customer"], "c_custkey"), [("referential_integrity", "customer", "foreign_key_violation", _orphan(), "count(customer)")]),
    ("streaming_referential_integrity", "children", lambda t: schemas.streaming_referential_integrity("customer", t["customer"], "c_custkey"), [("streaming_referential_integrity", "customer", "foreign_key_violation", _orphan(), "count(customer)")]),
    ("table_schema", "nation", lambda t: schemas.table_schema({"n_nationkey": "int", "n_flag": "string"}), [("table_schema", "n_flag", "missing_column", "max(1)", ONE)], {"grade": "critical"}),
    ("schema", "people", lambda t: schemas.schema_contract({c: {} for c in t["people"].columns} | {"balance": {"type": "double", "nullable": False, "min": 0.0}, "segment": {"type": "string", "allowed": ["BUILDING", "N/A"]}}), [("schema", "*", "ok", "max(0)", ONE), ("schema", "balance", "null_violation", _if("balance IS NULL")), ("schema", "balance", "below_min", _if("balance < 0")), ("schema", "segment", "not_allowed", _if("segment NOT IN ('BUILDING', 'N/A')"))]),
    ("table_column_count", "nation", lambda t: schemas.column_count(2, 2, name="table_column_count"), [("table_column_count", "*", "column_count", "max(1)", ONE)], HIGH),
    ("table_required_columns", "nation", lambda t: schemas.column_exists(["n_flag"], "table_required_columns"), [("table_required_columns", "n_flag", "missing_column", "max(1)", ONE)], {"grade": "critical"}),
    ("table_forbidden_columns", "nation", lambda t: schemas.column_not_exists(["n_name"], "table_forbidden_columns"), [("table_forbidden_columns", "n_name", "forbidden_column", "max(1)", ONE)], HIGH),
    ("table_freshness", "events", lambda t: schemas.table_freshness("ts", timedelta(hours=1), NOW), [_stat("table_freshness", "ts", "stale_table", f"date_diff('microsecond', max(ts), {SQL_NOW}) / 6e7", None, 60)], HIGH),
    ("table_data_recency", "events", lambda t: schemas.table_data_recency("ts", 5, 0.5, NOW), [_stat("table_data_recency", "ts", "too_few_recent_rows", "count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-26')::DOUBLE / count(*)", 0.5)], MEDIUM),
    ("table_update_frequency", "events", lambda t: schemas.table_update_frequency("ts", "hour"), [_stat("table_update_frequency", "ts", "update_gaps", "(date_diff('hour', min(ts), max(ts)) + 1 - count(DISTINCT date_trunc('hour', ts)))", None, 0)], MEDIUM),
    ("table_row_count_range", "nation", lambda t: schemas.row_count(1, 20, name="table_row_count_range"), [_stat("table_row_count_range", "*", "row_count", "count(*)", 1, 20)], HIGH),
    ("table_row_count_exact", "nation", lambda t: schemas.table_row_count_exact(20, 2), [_stat("table_row_count_exact", "*", "row_count", "count(*)", 18, 22)], HIGH),
    ("table_row_count_compare", "nation", lambda t: schemas.table_row_count_compare(t["region"]), [("table_row_count_compare", "*", "row_count_mismatch", "max(1)", ONE, "count(*)")], HIGH),
    ("table_not_empty", "nation", lambda t: schemas.table_not_empty(), [("table_not_empty", "*", "empty_table", "max(0)", ONE, "max(1)")], {"grade": "critical"}),
    ("table_schema_match", "nation", lambda t: schemas.table_schema_match({"n_nationkey": "int", "n_name": "string"}), [("table_schema_match", "n_regionkey", "unexpected_column", "max(1)", ONE)], {"grade": "critical"}),
    ("table_schema_compare", "region", lambda t: schemas.table_schema_compare(t["region"]), [("table_schema_compare", "*", "ok", "max(0)", ONE)]),
    ("table_column_types", "nation", lambda t: schemas.column_type({"n_name": ["int", "bool"]}, "table_column_types"), [("table_column_types", "n_name", "type_mismatch", "max(1)", ONE)], HIGH),
    ("table_memory_size", "nation", lambda t: schemas.table_memory_size(100), [_stat("table_memory_size", "*", "memory_size", "(count(*) * 8 + sum(strlen(n_name)))", None, 100)], MEDIUM),
    ("table_row_column_ratio", "nation", lambda t: schemas.table_row_column_ratio(20), [_stat("table_row_column_ratio", "*", "row_column_ratio", "(count(*) / 3.0)", 20)], {"grade": "low"}),
    ("table_dimensions", "nation", lambda t: schemas.table_dimensions(1, 20, 1, 5), [_stat("table_dimensions", "rows", "row_count", "count(*)", 1, 20), ("table_dimensions", "columns", "column_count", "max(0)", ONE, "max(3)")], HIGH),
    # multi-column
    ("column_sum", "rows3", lambda t: multi_column.column_sum(["discount", "tax"], "total", tolerance=0.01), [("column_sum", "discount,tax", "sum_mismatch", _if("a % 10 = 0"))]),
    ("column_product", "rows3", lambda t: multi_column.column_product(["q", "price"], max_value=2e6), [("column_product", "q,price", "product_mismatch", _if("q * price > 2e6"))]),
    ("column_difference", "rows3", lambda t: multi_column.column_difference(["discount", "tax"], min_value=0.0), [("column_difference", "discount,tax", "difference_mismatch", _if("discount - tax < 0"))]),
    ("column_ratio", "rows3", lambda t: multi_column.column_ratio(["discount", "tax"], max_value=2.0, handle_zero_division="fail"), [("column_ratio", "discount,tax", "ratio_mismatch", _if("tax = 0 OR discount / tax > 2.0"))]),
    ("column_percentage", "rows3", lambda t: multi_column.column_percentage(["discount", "tax"], max_value=200.5), [("column_percentage", "discount,tax", "percentage_mismatch", _if("tax <> 0 AND discount * 100 / tax > 200.5"))]),
    ("column_comparison", "rows3", lambda t: multi_column.column_comparison(["q", "line"], ">"), [("column_comparison", "q,line", "comparison_violation", _if("NOT q > line"))]),
    ("column_chain_comparison", "rows3", lambda t: multi_column.column_chain_comparison(["line", "q", "price"], ["<", "<"]), [("column_chain_comparison", "line,q,price", "chain_comparison_violation", _if("(NOT line < q) IS TRUE OR (NOT q < price) IS TRUE"))]),
    ("column_max", "rows3", lambda t: multi_column.column_max(["discount", "tax"], "total"), [("column_max", "discount,tax", "max_mismatch", _if("abs(greatest(discount, tax) - total) > 0"))]),
    ("column_min", "rows3", lambda t: multi_column.column_min(["discount", "tax"], "discount"), [("column_min", "discount,tax", "min_mismatch", _if("least(discount, tax) <> discount"))]),
    ("column_mean", "rows3", lambda t: multi_column.column_mean(["discount", "tax"], "total", 0.0105), [("column_mean", "discount,tax", "mean_mismatch", _if("abs((discount + tax) / 2 - total) > 0.0105"))]),
    ("column_consistency", "rows3", lambda t: multi_column.column_consistency([("flag = 'A'", "status = 'F'")]), [("column_consistency", "flag = ''A'' => status = ''F''", "inconsistent", _if("flag = 'A' AND status <> 'F'"), _if("flag = 'A'"))]),
    ("column_mutual_exclusivity", "rows3", lambda t: multi_column.column_mutual_exclusivity(["q", "flag2"]), [("column_mutual_exclusivity", "q,flag2", "not_exclusive", _if("(q IS NULL) = (flag2 IS NULL)"))]),
    ("column_coexistence", "rows3", lambda t: multi_column.column_coexistence(["q", "flag2"]), [("column_coexistence", "q,flag2", "partial_presence", _if("(q IS NULL) <> (flag2 IS NULL)"))]),
    ("column_dependency", "rows3", lambda t: multi_column.column_dependency("flag", ["A"], ["q", "flag2"]), [("column_dependency", "flag,q,flag2", "missing_dependency", _if("flag = 'A' AND (q IS NULL OR flag2 IS NULL)"), _if("flag = 'A'"))]),
    ("column_implication", "rows3", lambda t: multi_column.column_implication("flag", ["A"], "status", ["F"]), [("column_implication", "flag,status", "implication_violation", _if("flag = 'A' AND status <> 'F'"), _if("flag = 'A'"))]),
    ("column_correlation", "lineitem", lambda t: multi_column.column_correlation("l_quantity", "l_extendedprice", 0.99), [_stat("column_correlation", "l_quantity,l_extendedprice", "correlation_out_of_range", "corr(l_quantity, l_extendedprice)", 0.99)], MEDIUM),
    ("column_covariance", "lineitem", lambda t: multi_column.column_covariance("l_quantity", "l_discount", None, 10), [_stat("column_covariance", "l_quantity,l_discount", "covariance_out_of_range", "covar_samp(l_quantity, l_discount)", None, 10)], MEDIUM),
    ("multi_column_variance", "lineitem", lambda t: multi_column.multi_column_variance(["l_quantity", "l_discount"], max_variance=100.0), [_stat("multi_column_variance", "l_quantity", "variance_out_of_range", "var_samp(l_quantity)", None, 100.0), _stat("multi_column_variance", "l_discount", "variance_out_of_range", "var_samp(l_discount)", None, 100.0)], MEDIUM),
    # cross-table
    ("cross_table_aggregate", "shifted", lambda t: cross_table.cross_table_aggregate("o_orderkey", t["baseline"]), [("cross_table_aggregate", "o_orderkey", "aggregate_mismatch", "max(1)", ONE, "sum(o_orderkey)")], HIGH),
    ("cross_table_distinct_count", "orders", lambda t: cross_table.cross_table_distinct_count("o_custkey", t["customer"], "c_custkey"), [("cross_table_distinct_count", "o_custkey", "distinct_count_mismatch", "CASE WHEN count(DISTINCT o_custkey) <> (SELECT count(*) FROM customer) THEN 1 ELSE 0 END", ONE, "count(DISTINCT o_custkey)")], HIGH),
    ("optimized_cross_table_aggregate", "lineitem", lambda t: cross_table.grouped_aggregate("l_extendedprice", t["orders"].withColumnRenamed("o_orderkey", "l_orderkey"), "o_totalprice", ["l_orderkey"], tolerance=1000.0), [("optimized_cross_table_aggregate", "l_extendedprice", "aggregate_mismatch", "(SELECT count(*) FILTER (WHERE abs(coalesce(s, 0) - o_totalprice) > 1000) FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)", "(SELECT count(*) FROM orders)")]),
    ("cross_table_row_count", "lineitem", lambda t: cross_table.cross_table_row_count(t["orders"]), [("cross_table_row_count", "*", "row_count_mismatch", "max(1)", ONE, "count(*)")], HIGH),
    ("cross_table_row_count_factor", "lineitem", lambda t: cross_table.cross_table_row_count_factor(t["orders"], 4.0), [("cross_table_row_count_factor", "*", "row_count_factor_mismatch", "CASE WHEN abs(count(*) - 4.0 * (SELECT count(*) FROM orders)) > 0 THEN 1 ELSE 0 END", ONE, "count(*)")], HIGH),
    # query
    ("query_aggregate", "orders", lambda t: q.query_aggregate("SELECT max(o_totalprice) AS m FROM {data}", "m", max_value=1000), [_stat("query_aggregate", "m", "query_aggregate", "max(o_totalprice)", None, 1000)], HIGH),
    ("query_group_aggregate", "orders", lambda t: q.query_group_aggregate("SELECT o_orderstatus AS g, count(*) AS n FROM {data} GROUP BY 1", "g", "n", 6000, None, ["F", "X"]), [("query_group_aggregate", "n", "group_out_of_range", "(SELECT count(*) FROM (SELECT count(*) AS n FROM {source} GROUP BY o_orderstatus) WHERE n < 6000)", "count(DISTINCT o_orderstatus)"), ("query_group_aggregate", "g", "missing_group", "max(1)", "2")]),
    ("query_aggregate_compare", "orders", lambda t: q.query_aggregate_compare("SELECT max(o_totalprice) AS m FROM {data}", "SELECT max(c_acctbal) AS m FROM {customer}", "m", "less", customer=t["customer"]), [("query_aggregate_compare", "m", "aggregate_comparison", "CASE WHEN max(o_totalprice) < (SELECT max(c_acctbal) FROM customer) THEN 0 ELSE 1 END", ONE, "max(o_totalprice)")], HIGH),
    ("query_column_values", "orders", lambda t: q.query_column_values("SELECT o_orderstatus AS s FROM {data}", "s", ["F", "X"], allow_subset=False), [("query_column_values", "s", "unexpected_value", "count(DISTINCT o_orderstatus) FILTER (WHERE o_orderstatus <> 'F')", "count(DISTINCT o_orderstatus)"), ("query_column_values", "s", "missing_value", "max(1)", "2")]),
    ("query_column_unique", "orders", lambda t: q.query_column_unique("SELECT o_custkey FROM {data}", "o_custkey"), [("query_column_unique", "o_custkey", "duplicate_value", "count(*) - count(DISTINCT o_custkey)")]),
    ("query_column_not_null", "children", lambda t: q.query_column_not_null("SELECT customer FROM {data}", "customer"), [("query_column_not_null", "customer", "null", _if("customer IS NULL"))]),
    ("custom_expression", "rows3", lambda t: q.custom_expression("q < 40"), [("custom_expression", "*", "expression_failed", _if("q >= 40"))]),
    ("conditional_expression", "rows3", lambda t: q.conditional_expression("flag = 'A'", "q < 40"), [("conditional_expression", "*", "conditional_failed", _if("flag = 'A' AND q >= 40"), _if("flag = 'A'"))]),
    ("multi_condition", "rows3", lambda t: q.multi_condition(["q < 40", "line < 5"], "or"), [("multi_condition", "*", "conditions_failed", _if("NOT (q < 40 OR line < 5)"))]),
    ("row_level", "nation", lambda t: q.row_level(_even_key, ["n_nationkey", "n_name"]), [("row_level", "n_nationkey,n_name", "row_rejected", _if("n_nationkey % 2 = 1"))]),
    ("query_returns_single_value", "nation", lambda t: q.query_returns_single_value("SELECT count(*) AS n FROM {data}", 24), [("query_returns_single_value", "*", "unexpected_value", "CASE WHEN count(*) <> 24 THEN 1 ELSE 0 END", ONE, "count(*)")], HIGH),
    ("query_returns_no_rows", "nation", lambda t: q.query_returns_no_rows("SELECT * FROM {data} WHERE n_regionkey = 1"), [("query_returns_no_rows", "*", "unexpected_rows", _if("n_regionkey = 1"))]),
    ("query_returns_rows", "nation", lambda t: q.query_returns_rows("SELECT * FROM {data} WHERE n_regionkey = 9"), [("query_returns_rows", "*", "query_row_count", "max(1)", ONE, "max(0)")], HIGH),
    ("query_result_matches", "nation", lambda t: q.query_result_matches("SELECT n_regionkey AS r FROM {data}", t["region"].selectExpr("r_regionkey AS r")), [("query_result_matches", "*", "result_mismatch", "(SELECT count(*) FROM nation) - (SELECT count(*) FROM region)", "(SELECT count(*) FROM region)")], HIGH),
    ("query_row_count", "nation", lambda t: q.query_row_count("SELECT * FROM {data} WHERE n_regionkey = 1", 4), [("query_row_count", "*", "query_row_count", "CASE WHEN count(*) FILTER (WHERE n_regionkey = 1) <> 4 THEN 1 ELSE 0 END", ONE, _if("n_regionkey = 1"))], HIGH),
    ("query_row_count_ratio", "orders", lambda t: q.query_row_count_ratio("SELECT * FROM {data} WHERE o_orderstatus = 'F'", 0.9), [_stat("query_row_count_ratio", "*", "row_count_ratio", "count(*) FILTER (WHERE o_orderstatus = 'F')::DOUBLE / count(*)", 0.9)], MEDIUM),
    ("query_row_count_compare", "orders", lambda t: q.query_row_count_compare("SELECT * FROM {data}", "SELECT * FROM {c}", "less", c=t["customer"]), [("query_row_count_compare", "*", "row_count_comparison", "max(1)", ONE, "count(*)")], HIGH),
    # referential
    ("foreign_key", "children", lambda t: referential.foreign_key(["customer"], t["customer"], ["c_custkey"], False), [("foreign_key", "customer", "foreign_key_violation", _orphan() + " + count(*) FILTER (WHERE customer IS NULL)")], HIGH),
    ("composite_foreign_key", "rows3", lambda t: referential.composite_foreign_key(["flag", "status"], t["rows3"].where("line = 1 and flag <> 'A'"), ["flag", "status"], True), [("composite_foreign_key", "flag,status", "composite_foreign_key_violation", _if("flag = 'A'")), ("composite_foreign_key", "flag,status", "partial_match", "max(0)", "count(*)", "NULL", "medium")], HIGH),
    ("self_referential_fk", "tree", lambda t: referential.self_referential_fk("parent", "id"), [("self_referential_fk", "parent", "self_reference_violation", _if("parent IS NOT NULL AND parent NOT IN (SELECT c_custkey FROM customer)"))], HIGH),
    ("orphan_record", "children", lambda t: referential.orphan_record(["customer"], t["customer"], ["c_custkey"]), [("orphan_record", "customer", "orphan_record", _orphan())], HIGH),
    ("dangling_reference", "customer", lambda t: referential.dangling_reference(t["children"], ["customer"], ["c_custkey"], 0.0001), [("dangling_reference", "c_custkey", "dangling_reference", _if("c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderkey % 31 <> 0)"))], {"limit": 0.0001, "grade": "low"}),
    ("circular_reference", "nation", lambda t: referential.circular_reference([referential.Relation("a", ("x",), "b", ("y",)), referential.Relation("b", ("x",), "a", ("y",))]), [("circular_reference", "a,b", "circular_reference", "max(1)", ONE)], HIGH),
    ("cascade_depth", "nation", lambda t: referential.cascade_depth([referential.Relation("lineitem", ("x",), "orders", ("y",)), referential.Relation("orders", ("x",), "customer", ("y",))], 1), [("cascade_depth", "lineitem", "cascade_too_deep", "max(1)", ONE)], MEDIUM),
    ("hierarchy_circular", "tree", lambda t: referential.hierarchy_circular("id", "parent"), [("hierarchy_circular", "parent", "circular_hierarchy", CIRCLE, "count(*)", DEEPEST)], HIGH),
    ("optimized_hierarchy_circular", "tree", lambda t: referential.hierarchy_circular("id", "parent", 1000, "optimized_hierarchy_circular"), [("optimized_hierarchy_circular", "parent", "circular_hierarchy", CIRCLE, "count(*)", DEEPEST)], HIGH),
    ("hierarchy_depth", "tree", lambda t: referential.hierarchy_depth("id", "parent", 5), [("hierarchy_depth", "parent", "hierarchy_too_deep", f"(SELECT count(*) FILTER (WHERE d > 5) FROM {DEPTHS})", "count(*)", DEEPEST)], HIGH),
    # anomaly
    ("iqr_anomaly", "events", lambda t: anomaly.iqr_anomaly("value", 1.5, 0.01), [("iqr_anomaly", "value", "anomaly", _if(_fence("value", 1.5)))], {"limit": 0.01} | TEN),
    ("tukey_fences", "events", lambda t: anomaly.tukey_fences("value", max_anomaly_ratio=0.01), [("tukey_fences", "value", "mild_outlier", _if(_fence("value", 1.5) + " AND NOT " + _fence("value", 3.0))), ("tukey_fences", "value", "extreme_outlier", _if(_fence("value", 3.0)))], {"limit": 0.01} | TEN),
    ("percentile_anomaly", "events", lambda t: anomaly.percentile_anomaly("value", 5, 95, 0.01), [("percentile_anomaly", "value", "anomaly", _if(f"value < {_q('value', 0.05)} OR value > {_q('value', 0.95)}"))], {"limit": 0.01} | TEN),
    ("mad_anomaly", "events", lambda t: anomaly.mad_anomaly("value", 3.5, 0.01), [("mad_anomaly", "value", "anomaly", _if(f"0.6745 * abs(value - {_q('value', 0.5)}) / (SELECT quantile_cont(abs(value - m), 0.5) FROM {{source}}, (SELECT quantile_cont(value, 0.5) AS m FROM {{source}})) > 3.5"))], {"limit": 0.01} | TEN),
    ("grubbs_test", "events", lambda t: anomaly.grubbs_test("value", max_anomaly_ratio=0.0), []),
    ("zscore_multivariate", "lineitem", lambda t: anomaly.zscore_multivariate(["l_quantity", "l_extendedprice"], 1.5, "any", 0.1), [("zscore_multivariate", "l_quantity,l_extendedprice", "anomaly", _if("abs(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem) > 1.5 OR abs(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem) > 1.5"))], {"limit": 0.1} | TEN),
    ("mahalanobis", "lineitem", lambda t: anomaly.mahalanobis(["l_quantity", "l_discount"], 80.0, max_anomaly_ratio=0.01), [("mahalanobis", "l_quantity,l_discount", "anomaly", "(SELECT count(*) FROM (SELECT l_quantity - mx AS x, l_discount - my AS y, vx, vy, vxy FROM lineitem, (SELECT avg(l_quantity) AS mx, avg(l_discount) AS my, var_samp(l_quantity) AS vx, var_samp(l_discount) AS vy, covar_samp(l_quantity, l_discount) AS vxy FROM lineitem)) WHERE (x * x * vy - 2 * x * y * vxy + y * y * vx) / (vx * vy - vxy * vxy) > 3.2188758)")], {"limit": 0.01} | TEN),
    ("optimized_mahalanobis", "lineitem", lambda t: anomaly.mahalanobis(["l_quantity", "l_discount", "l_tax"], 97.5, True, 0.01, "optimized_mahalanobis"), []),
    ("elliptic_envelope", "lineitem", lambda t: anomaly.elliptic_envelope(["l_quantity", "l_extendedprice"]), []),
    ("pca_anomaly", "lineitem", lambda t: anomaly.pca_anomaly(["l_quantity", "l_extendedprice", "l_discount"], 2), []),
    # drift
    ("mean_drift", "shifted", lambda t: drift.mean_drift("o_totalprice", t["baseline"]), [_drifted("mean_drift", "o_totalprice", "mean_drift", _change("avg(o_totalprice)"), 10.0)]),
    ("variance_drift", "shifted", lambda t: drift.variance_drift("o_totalprice", t["baseline"], 10.0), [_drifted("variance_drift", "o_totalprice", "variance_drift", _change("stddev_samp(o_totalprice)"), 10.0)]),
    ("quantile_drift", "shifted", lambda t: drift.quantile_drift("o_totalprice", t["baseline"]), [_drifted("quantile_drift", "o_totalprice", f"quantile_{p}_drift", _change(f"quantile_cont(o_totalprice, {p})"), 15.0) for p in (0.25, 0.5, 0.75)]),
    ("range_drift", "shifted", lambda t: drift.range_drift("o_totalprice", t["baseline"]), [_drifted("range_drift", "o_totalprice", f"{e}_drift", _change(f"{e}(o_totalprice)"), 10.0) for e in ("min", "max")]),
    ("streaming_ks_test", "shifted", lambda t: drift.ks_test("o_totalprice", t["baseline"], statistic_threshold=0.03, name="streaming_ks_test"), [("streaming_ks_test", "o_totalprice", "distribution_drift", f"CASE WHEN {KS} > 0.03 THEN 1 ELSE max(0) END", ONE, KS)], HIGH),
    ("chi_square_drift", "shifted", lambda t: drift.chi_square_drift("o_orderstatus", t["baseline"]), [("chi_square_drift", "o_orderstatus", "category_drift", f"CASE WHEN {CHI2} > 5.9915 THEN 1 ELSE max(0) END", ONE, CHI2)], HIGH),
    ("feature_drift", "shifted", lambda t: drift.feature_drift(["o_totalprice", "o_orderstatus"], t["baseline"], categorical_columns=["o_orderstatus"]), []),
    # profiling
    ("cardinality", "orders", lambda t: profiling.cardinality("o_custkey", 0.5), [_stat("cardinality", "o_custkey", "cardinality_ratio", "count(DISTINCT o_custkey)::DOUBLE / count(*)", 0.5, 1.0)], MEDIUM),
    ("uniqueness_ratio", "orders", lambda t: profiling.uniqueness_ratio("o_custkey", 0.5), [_stat("uniqueness_ratio", "o_custkey", "uniqueness_ratio", "count(DISTINCT o_custkey)::DOUBLE / count(*)", 0.5, 1.0)], MEDIUM),
    ("entropy", "orders", lambda t: profiling.entropy("o_orderpriority", 3.0), [_stat("entropy", "o_orderpriority", "entropy_out_of_range", _entropy("o_orderpriority"), 3.0), ("entropy", "o_orderpriority", "normalized_entropy_out_of_range", "max(0)", ONE, _entropy("o_orderpriority") + " / log2(5)")], MEDIUM),
    ("information_gain", "lineitem", lambda t: profiling.information_gain("l_returnflag", "l_linestatus", 0.5), [("information_gain", "l_returnflag,l_linestatus", "information_gain", f"CASE WHEN {_entropy('l_linestatus')} + {_entropy('l_returnflag')} - {_entropy('l_returnflag || l_linestatus')} < 0.5 THEN 1 ELSE max(0) END", ONE, f"{_entropy('l_linestatus')} + {_entropy('l_returnflag')} - {_entropy('l_returnflag || l_linestatus')}")], MEDIUM),
    ("value_frequency", "orders", lambda t: profiling.value_frequency("o_orderpriority", max_top=0.1, top_n_max_ratio=0.3, top_n=2), [("value_frequency", "o_orderpriority", "top_frequency", "max(1)", ONE, "(SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))::DOUBLE / count(*)"), ("value_frequency", "o_orderpriority", "bottom_frequency", "max(0)", ONE, "(SELECT min(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority))::DOUBLE / count(*)"), ("value_frequency", "o_orderpriority", "top_n_concentration", "max(1)", ONE, "(SELECT sum(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC LIMIT 2))::DOUBLE / count(*)")], MEDIUM),
    ("distribution_shape", "orders", lambda t: profiling.distribution_shape("o_custkey", "any", min_gini=0.9), [("distribution_shape", "o_custkey", "gini_out_of_range", "max(1)", ONE, "(SELECT 2 * sum(n * r) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) FROM (SELECT n, row_number() OVER (ORDER BY n) AS r FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)))")], MEDIUM),
    # time series
    ("timeseries_completeness", "series", lambda t: timeseries.timeseries_completeness("ts", 60.0), [("timeseries_completeness", "ts", "incomplete_series", "CASE WHEN count(*)::DOUBLE / (floor(date_diff('microsecond', min(ts), max(ts)) / 60e6) + 1) < 0.95 THEN 1 ELSE 0 END", ONE, "least(count(*)::DOUBLE / (floor(date_diff('microsecond', min(ts), max(ts)) / 60e6) + 1), 1.0)")], MEDIUM),
    ("timeseries_value_completeness", "series", lambda t: timeseries.timeseries_value_completeness("ts", "value", 0.04, 1), [("timeseries_value_completeness", "value", "null_values", _if("value IS NULL"), "count(*)", "count(*) FILTER (WHERE value IS NULL)::DOUBLE / count(*)"), ("timeseries_value_completeness", "value", "consecutive_nulls", "max(0)", ONE, "max(1)", "medium")], {"limit": 0.04}),
    ("timeseries_date_range", "series", lambda t: timeseries.timeseries_date_range("ts", datetime(2024, 1, 1), NOW, 3600.0, 3600.0), [_stat("timeseries_date_range", "ts", "late_start", "(date_diff('microsecond', TIMESTAMP '2024-01-01', min(ts)) / 1e6)", None, 3600), _stat("timeseries_date_range", "ts", "early_end", f"(date_diff('microsecond', max(ts), {SQL_NOW}) / 1e6)", None, 3600)], HIGH),
    ("timeseries_gap", "series", lambda t: timeseries.timeseries_gap("ts", 60.0), [("timeseries_gap", "ts", "time_gap", f"(SELECT count(*) FILTER (WHERE gap > 120) FROM {DIFFS})", f"(SELECT count(gap) FROM {DIFFS})")], {"limit": 0.05}),
    ("timeseries_interval", "series", lambda t: timeseries.timeseries_interval("ts", 1.0, 600.0, 10.0), [("timeseries_interval", "ts", "interval_too_short", f"(SELECT count(*) FILTER (WHERE gap < 1) FROM {DIFFS})", f"(SELECT count(gap) FROM {DIFFS})"), ("timeseries_interval", "ts", "interval_too_long", f"(SELECT count(*) FILTER (WHERE gap > 600) FROM {DIFFS})", f"(SELECT count(gap) FROM {DIFFS})"), ("timeseries_interval", "ts", "irregular_intervals", f"CASE WHEN (SELECT stddev_pop(gap) FROM {DIFFS}) > 10 THEN 1 ELSE max(0) END", ONE, f"(SELECT stddev_pop(gap) FROM {DIFFS})", "medium")]),
    ("timeseries_duplicate", "orders", lambda t: timeseries.timeseries_duplicate("o_orderdate"), [("timeseries_duplicate", "o_orderdate", "duplicate_timestamp", "count(o_orderdate) - count(DISTINCT o_orderdate)")]),
    ("timeseries_monotonic", "series", lambda t: timeseries.timeseries_monotonic("ts", "value"), [("timeseries_monotonic", "value", "not_monotonic", "(SELECT count(*) FILTER (WHERE value < p) FROM (SELECT value, lag(value) OVER (ORDER BY ts, value) AS p FROM {source} WHERE value IS NOT NULL))", "count(value) - 1")]),
    ("timeseries_order", "series", lambda t: timeseries.timeseries_order("ts", "seq"), [("timeseries_order", "ts", "out_of_order", "max(0)", "count(*)")]),
    ("seasonality", "daily", lambda t: timeseries.seasonality("ts", "value", 7), []),
    ("seasonal_decomposition", "daily", lambda t: timeseries.seasonal_decomposition("ts", "value", 7), []),
    ("trend", "series", lambda t: timeseries.trend("ts", "value", "increasing"), [("trend", "value", "trend_direction", f"CASE WHEN (SELECT regr_slope(x, i) FROM {SERIES}) > 0.001 THEN 0 ELSE max(1) END", ONE, f"(SELECT regr_slope(x, i) FROM {SERIES})"), ("trend", "value", "trend_strength", "max(0)", ONE, f"(SELECT abs(regr_slope(x, i)) FROM {SERIES})"), ("trend", "value", "trend_fit", "max(0)", ONE, f"(SELECT regr_r2(x, i) FROM {SERIES})")], MEDIUM),
    ("trend_break", "daily", lambda t: timeseries.trend_break("ts", "value", 0.5, 10), []),
    # geospatial
    ("geo_bounding_box", "places", lambda t: geospatial.geo_bounding_box("lat", "lon", region="europe"), [("geo_bounding_box", "lat,lon", "outside_box", _if("NOT (lat BETWEEN 34 AND 72 AND lon BETWEEN -25 AND 45)"))]),
    ("geo_country", "places", lambda t: geospatial.geo_country("lat", "lon", "US"), [("geo_country", "lat,lon", "outside_country", _if("NOT (lat BETWEEN 24.5 AND 49.4 AND lon BETWEEN -125 AND -66.9)"))]),
    ("latitude", "places", lambda t: geospatial.latitude("lat"), [("latitude", "lat", "invalid_latitude", _if("abs(lat) > 90"))]),
    ("longitude", "places", lambda t: geospatial.longitude("lon"), [("longitude", "lon", "invalid_longitude", _if("abs(lon) > 180"))]),
    ("coordinate", "places", lambda t: geospatial.coordinate("lat", "lon"), [("coordinate", "lat", "invalid_latitude", _if("abs(lat) > 90")), ("coordinate", "lon", "invalid_longitude", _if("abs(lon) > 180"))]),
    ("coordinate_not_null_island", "places", lambda t: geospatial.coordinate_not_null_island("lat", "lon"), [("coordinate_not_null_island", "lat,lon", "null_island", _if("lat = 0 AND lon = 0"))]),
    ("geo_distance", "places", lambda t: geospatial.geo_distance("lat", "lon", "lat2", "lon2", max_distance=8000), [("geo_distance", "lat,lon,lat2,lon2", "distance_out_of_range", _if(f"{DIST} > 8000"))]),
    ("geo_distance_from_point", "places", lambda t: geospatial.geo_distance_from_point("lat", "lon", 37.5, 127.0, max_distance=5000), [("geo_distance_from_point", "lat,lon", "distance_out_of_range", _if(f"{FROM_SEOUL} > 5000"))]),
    ("optimized_geo_distance", "places", lambda t: geospatial.geo_distance("lat", "lon", "lat2", "lon2", min_distance=1000, name="optimized_geo_distance"), [("optimized_geo_distance", "lat,lon,lat2,lon2", "distance_out_of_range", _if(f"{DIST} < 1000"))]),
    ("polygon", "places", lambda t: geospatial.polygon("lat", "lon", SQUARE), [("polygon", "lat,lon", "outside_polygon", _if(f"NOT {IN_SQUARE}"))]),
    ("multi_polygon", "places", lambda t: geospatial.multi_polygon("lat", "lon", [SQUARE, BOX]), [("multi_polygon", "lat,lon", "outside_polygon", _if(f"NOT ({IN_SQUARE} OR {IN_BOX})"))]),
    ("polygon_distance", "places", lambda t: geospatial.polygon_distance("lat", "lon", SQUARE, max_distance_km=1000), [("polygon_distance", "lat,lon", "distance_out_of_range", _if("sqrt(pow(greatest(-30 - lat, lat - 50, 0), 2) + pow(greatest(-50 - lon, lon - 60, 0), 2)) * 111 > 1000"))]),
    # business rules and localisation
    ("luhn", "codes", lambda t: business.luhn("card"), [("luhn", "card", "invalid_luhn", _if("id % 3 = 1"), "count(card)")], TEN),
    ("credit_card", "codes", lambda t: business.credit_card("card"), [("credit_card", "card", "invalid_credit_card", _if("id % 3 = 1"), "count(card)")], TEN),
    ("isbn", "codes", lambda t: business.isbn("isbn"), [("isbn", "isbn", "invalid_isbn", _if("id % 4 = 1"))], TEN),
    ("iban", "codes", lambda t: business.iban("iban"), [("iban", "iban", "invalid_iban", _if("id % 3 = 2"))], TEN),
    ("vat", "codes", lambda t: business.vat("vat"), [("vat", "vat", "invalid_vat", _if("id % 3 = 2"))], TEN),
    ("swift", "codes", lambda t: business.swift("swift"), [("swift", "swift", "invalid_swift", _if("id % 3 = 2"))], TEN),
    ("chinese_id", "codes", lambda t: business.chinese_id("chinese"), [("chinese_id", "chinese", "invalid_chinese_id", _if("id % 3 <> 0"))], TEN),
    ("chinese_uscc", "codes", lambda t: business.chinese_uscc("uscc"), [("chinese_uscc", "uscc", "invalid_chinese_uscc", _if("id % 2 = 1"))], TEN),
    ("japanese_postal_code", "codes", lambda t: business.japanese_postal_code("postal"), [("japanese_postal_code", "postal", "invalid_japanese_postal_code", _if("id % 3 = 2"))], TEN),
    ("japanese_my_number", "codes", lambda t: business.japanese_my_number("mynumber"), [("japanese_my_number", "mynumber", "invalid_japanese_my_number", _if("id % 2 = 1"))], TEN),
    ("korean_business_number", "codes", lambda t: business.korean_business_number("business"), [("korean_business_number", "business", "invalid_korean_business_number", _if("id % 2 = 1"))], TEN),
    ("korean_rrn", "codes", lambda t: business.korean_rrn("rrn"), [("korean_rrn", "rrn", "invalid_korean_rrn", _if("id % 3 <> 0"))], TEN),
    ("korean_phone", "codes", lambda t: business.korean_phone("kphone"), [("korean_phone", "kphone", "invalid_korean_phone", _if("id % 3 = 2"))], TEN),
    ("korean_bank_account", "codes", lambda t: business.korean_bank_account("account", "bank"), [("korean_bank_account", "account", "invalid_korean_bank_account", _if("id % 2 = 1"))], TEN),
    # features for models
    ("feature_correlation_matrix", "lineitem", lambda t: ml_feature.feature_correlation_matrix(["l_quantity", "l_extendedprice"], 0.5), [("feature_correlation_matrix", "l_quantity,l_extendedprice", "high_correlation", "CASE WHEN abs(corr(l_quantity, l_extendedprice)) > 0.5 THEN 1 ELSE 0 END", ONE, "corr(l_quantity, l_extendedprice)")], MEDIUM),
    ("target_leakage", "rows3", lambda t: ml_feature.target_leakage("total", ["discount"], 0.2), [("target_leakage", "discount", "target_correlation", "CASE WHEN abs(corr(discount, total)) > 0.2 THEN 1 ELSE 0 END", ONE, "corr(discount, total)")], {"grade": "critical"}),
    ("feature_null_impact", "rows3", lambda t: ml_feature.feature_null_impact(["q", "flag2"], 0.2), [("feature_null_impact", "q", "high_null_ratio", _if("q IS NULL")), ("feature_null_impact", "flag2", "high_null_ratio", _if("flag2 IS NULL")), ("feature_null_impact", "q,flag2", "null_correlation", "max(0)", ONE, "corr((q IS NULL)::INT, (flag2 IS NULL)::INT)", "medium")], {"limit": 0.2}),
    ("feature_scale", "lineitem", lambda t: ml_feature.feature_scale(["l_quantity", "l_discount"], 100.0, 40.0), [("feature_scale", "l_quantity", "large_magnitude", "max(1)", ONE, "max(l_quantity)"), ("feature_scale", "l_discount", "large_magnitude", "max(0)", ONE, "max(l_discount)"), ("feature_scale", "l_quantity,l_discount", "scale_ratio", "max(1)", ONE, "(max(l_quantity) - min(l_quantity)) / (max(l_discount) - min(l_discount))")], MEDIUM),
    # privacy
    ("data_retention", "events", lambda t: privacy.data_retention("ts", 10, NOW), [("data_retention", "ts", "retention_exceeded", _if("ts < TIMESTAMP '2024-01-21'"))], HIGH),
    ("consent_tracking", "people", lambda t: privacy.consent_tracking("consent", ["email"]), [("consent_tracking", "consent", "missing_consent", _if("coalesce(consent, '') <> 'yes'"))], {"grade": "critical"}),
    ("ccpa_do_not_sell", "flags", lambda t: privacy.ccpa_do_not_sell("deleted", ["email"]), [("ccpa_do_not_sell", "deleted", "shared_after_optout", _if("deleted = 'true' AND email IS NOT NULL"), _if("deleted = 'true'"))], {"grade": "critical"}),
    ("ccpa_consumer_rights", "flags", lambda t: privacy.ccpa_consumer_rights("user_id", "email"), [("ccpa_consumer_rights", "user_id", "null_consumer_id", _if("user_id IS NULL"), "count(*)", "NULL", "medium"), ("ccpa_consumer_rights", "email", "pending_deletion", "count(email)", "count(*)", "NULL", "high")]),
    ("gdpr_right_to_erasure", "flags", lambda t: privacy.gdpr_right_to_erasure("deleted", ["email"]), [("gdpr_right_to_erasure", "deleted", "personal_data_after_deletion", _if("deleted = 'true' AND email IS NOT NULL"), _if("deleted = 'true'"))], {"grade": "critical"}),
    ("gdpr_data_minimization", "flags", lambda t: privacy.gdpr_data_minimization(0.2, 0), [("gdpr_data_minimization", "email", "unused_personal_data", _if("email IS NULL")), ("gdpr_data_minimization", "*", "too_many_personal_columns", "max(1)", ONE, "max(1)")], {"limit": 0.2, "grade": "medium"}),
    ("gdpr_special_category", "people", lambda t: privacy.gdpr_special_category(), [("gdpr_special_category", "*", "ok", "max(0)", ONE)]),
    ("ccpa_sensitive_info", "people", lambda t: privacy.ccpa_sensitive_info(), [("ccpa_sensitive_info", "*", "ok", "max(0)", ONE)]),
    ("gdpr_compliance", "people", lambda t: privacy.gdpr_compliance(), []),
    ("ccpa_compliance", "people", lambda t: privacy.ccpa_compliance(), []),
    ("lgpd_compliance", "people", lambda t: privacy.lgpd_compliance(), []),
    ("pipeda_compliance", "people", lambda t: privacy.pipeda_compliance(), []),
    ("appi_compliance", "people", lambda t: privacy.appi_compliance(), []),
    ("global_privacy", "people", lambda t: privacy.global_privacy(("gdpr", "ccpa")), []),
    ("plugin_based_privacy", "codes", lambda t: privacy.plugin_based_privacy("pci_dss"), []),
    # streaming checks, over a batch
    ("streaming_null", "people", lambda t: windows.streaming_null("balance"), [("streaming_null", "balance", "null", _if("balance IS NULL"))]),
    ("streaming_completeness", "people", lambda t: windows.streaming_completeness("balance"), [("streaming_completeness", "balance", "low_completeness", _if("balance IS NULL"))], {"limit": 0.05}),
    ("streaming_nan", "people", lambda t: windows.streaming_nan("reading"), [("streaming_nan", "reading", "nan", _if("isnan(reading)"), "count(reading)")]),
    ("streaming_range", "people", lambda t: windows.streaming_range("age", 0, 90), [("streaming_range", "age", "out_of_range", _if("age < 0 OR age > 90"))]),
    ("streaming_outlier", "events", lambda t: windows.streaming_outlier("value"), [("streaming_outlier", "value", "outlier", _if(_fence("value", 1.5)), "count(value)")]),
    ("streaming_positive", "people", lambda t: windows.streaming_positive("age"), [("streaming_positive", "age", "not_positive", _if("age <= 0"))]),
    # one's own checks
    ("simple_column", "people", lambda t: sdk.simple_column("short", lambda x: F.length(x) < 12, "segment"), [("short", "segment", "short_failed", _if("length(segment) >= 12"), "count(segment)")]),
    ("simple_pattern", "people", lambda t: sdk.simple_pattern("starts_x", "^x", "mixed"), [("starts_x", "mixed", "starts_x_failed", _if("mixed NOT LIKE 'x%'"))]),
    ("simple_range", "people", lambda t: sdk.simple_range("adult", 18, None, "age"), [("adult", "age", "adult_failed", _if("age < 18"))]),
    ("simple_comparison", "rows3", lambda t: sdk.simple_comparison("below", "discount", "<", F.col("tax")), [("below", "discount", "below_failed", _if("NOT discount < tax"))]),
    ("composite", "people", lambda t: sdk.composite("both", [completeness.null("balance"), distribution.positive("age")]), [("both", "balance", "null", _if("balance IS NULL")), ("both", "age", "not_positive", _if("age <= 0"), "count(age)")]),
    ("check_builder", "people", lambda t: sdk.CheckBuilder("young").column("age").violates(lambda c: c < 18).mostly(0.5).severity("high").build(), [("young", "age", "young_failed", _if("age < 18"))], {"limit": 0.5, "grade": "high"}),
]


def _even_key(row: dict) -> bool:
    return row["n_nationkey"] % 2 == 0
