"""Columns, types, table sizes, and rules over pairs of columns."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import Check, Measure, count_if, graded, literal_rows, outside, rows

# Other names of types.
ALIASES = {
    "int": ("tinyint", "smallint", "int", "bigint"), "integer": ("tinyint", "smallint", "int", "bigint"), "int64": ("bigint",), "int32": ("int",), "long": ("bigint",),
    "float": ("float", "double"), "float64": ("double",), "float32": ("float",), "double": ("double",), "numeric": ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"),
    "str": ("string",), "string": ("string",), "utf8": ("string",), "text": ("string",), "bool": ("boolean",), "boolean": ("boolean",), "date": ("date",),
    "datetime": ("timestamp", "timestamp_ntz"), "timestamp": ("timestamp", "timestamp_ntz"), "list": ("array",), "array": ("array",), "struct": ("struct",), "binary": ("binary",), "decimal": ("decimal",),
}
OPERATORS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "=": operator.eq, "!=": operator.ne, "<>": operator.ne}


def type_fits(actual: str, wanted: str | Sequence[str]) -> bool:
    base = actual.split("(")[0].split("<")[0]
    return any(base in ALIASES.get(w.lower(), (w.lower(),)) or actual == w for w in ([wanted] if isinstance(wanted, str) else wanted))


def _number(name: str, column: str, issue: str, value: Column, low, high, grade="high") -> Measure:
    return Measure(name, column, issue, outside(value, low, high), F.lit(1), value, grade=grade)


def _columns(name: str, low, high) -> Check:
    return Check(name, lambda df: literal_rows(df, name, [("*", "column_count")] if low is not None and len(df.columns) < low or high is not None and len(df.columns) > high else [], "high"))


def column_count(min_count: int | None = None, max_count: int | None = None, exact_count: int | None = None, name: str = "column_count") -> Check:
    return _columns(name, *((exact_count, exact_count) if exact_count is not None else (min_count, max_count)))


def row_count(min_count: int | None = None, max_count: int | None = None, exact_count: int | None = None, name: str = "row_count") -> Check:
    low, high = (exact_count, exact_count) if exact_count is not None else (min_count, max_count)
    return Check(name, lambda df: [_number(name, "*", "row_count", rows(), low, high)])


def column_exists(columns: Sequence[str], name: str = "column_exists") -> Check:
    return Check(name, lambda df: literal_rows(df, name, [(c, "missing_column") for c in columns if c not in df.columns]))


def column_not_exists(columns: Sequence[str], name: str = "column_not_exists") -> Check:
    return Check(name, lambda df: literal_rows(df, name, [(c, "forbidden_column") for c in columns if c in df.columns], "high"))


def column_order(expected_order: Sequence[str], strict: bool = True) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        have = df.columns if strict else [c for c in df.columns if c in expected_order]
        want = list(expected_order) if strict else [c for c in expected_order if c in df.columns]
        return literal_rows(df, "column_order", [("*", "column_order")] if have != want else [], "medium")

    return Check("column_order", plan)


def column_type(expected_types: Mapping[str, str | Sequence[str]], name: str = "column_type") -> Check:
    def plan(df: DataFrame) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        return literal_rows(df, name, [(c, "type_mismatch") for c, t in expected_types.items() if c in kinds and not type_fits(kinds[c], t)], "high")

    return Check(name, plan)


def schema_found(df: DataFrame, expected: Mapping[str, str | Sequence[str]], extra: bool, order: bool, types: bool = True) -> list[tuple[str, str]]:
    """Differences between a table's columns and the expected ones."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    found = [(c, "missing_column") for c in expected if c not in kinds]
    found += [(c, "unexpected_column") for c in kinds if c not in expected] if extra else []
    found += [(c, "type_mismatch") for c, t in expected.items() if types and c in kinds and not type_fits(kinds[c], t)]
    shared = [c for c in df.columns if c in expected]
    return found + ([("*", "column_order")] if order and shared != [c for c in expected if c in kinds] else [])


def table_schema(expected_schema: Mapping[str, str], allow_extra_columns: bool = True) -> Check:
    return Check("table_schema", lambda df: literal_rows(df, "table_schema", schema_found(df, expected_schema, not allow_extra_columns, False)))


def table_schema_match(expected_schema: Mapping[str, str], strict: bool = True, check_order: bool = False) -> Check:
    return Check("table_schema_match", lambda df: literal_rows(df, "table_schema_match", schema_found(df, expected_schema, strict, check_order)))


def table_schema_compare(reference: DataFrame, check_types: bool = True, check_order: bool = False, ignore_columns: Sequence[str] = ()) -> Check:
    expected = {f.name: f.dataType.simpleString() for f in reference.schema.fields if f.name not in ignore_columns}
    return Check("table_schema_compare", lambda df: literal_rows(df, "table_schema_compare", schema_found(df.drop(*ignore_columns), expected, True, check_order, check_types)))


def column_pair(column_a: str, column_b: str, relationship: str) -> Check:
    a, b = F.col(column_a), F.col(column_b)
    return Check("column_pair", lambda df: [Measure("column_pair", f"{column_a},{column_b}", "column_pair_violation", count_if(~OPERATORS[relationship](a, b)), count_if(a.isNotNull() & b.isNotNull()))])


def _in_pairs(column_a: str, column_b: str, pairs: Sequence[tuple]) -> Column:
    hit = F.lit(False)
    by_first: dict[object, list] = {}
    for x, y in pairs:
        by_first.setdefault(x, []).append(y)
    for x, ys in by_first.items():
        hit = hit | ((F.col(column_a) == x) & F.col(column_b).isin(ys))
    return hit


def column_pair_in_set(column_a: str, column_b: str, valid_pairs: Sequence[tuple], ignore_nulls: bool = True) -> Check:
    whole = F.col(column_a).isNotNull() & F.col(column_b).isNotNull()
    bad = ~F.coalesce(_in_pairs(column_a, column_b, valid_pairs), F.lit(False))
    return Check("column_pair_in_set", lambda df: [Measure("column_pair_in_set", f"{column_a},{column_b}", "invalid_pair", count_if(bad & whole if ignore_nulls else bad))])


def column_pair_not_in_set(column_a: str, column_b: str, forbidden_pairs: Sequence[tuple]) -> Check:
    return Check("column_pair_not_in_set", lambda df: [Measure("column_pair_not_in_set", f"{column_a},{column_b}", "forbidden_pair", count_if(_in_pairs(column_a, column_b, forbidden_pairs)), grade="high")])


def multi_column_unique(columns: Sequence[str]) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        one = df.groupBy(*columns).count().agg(F.sum(F.col("count") - 1).alias("bad"), F.sum("count").alias("total"))
        return graded(one, "multi_column_unique", ",".join(columns), "duplicate_key", F.col("bad"), F.col("total"))

    return Check("multi_column_unique", plan)


def multi_column_sum(columns: Sequence[str], equals_column: str | None = None, equals_value: float | None = None, tolerance: float = 0.0) -> Check:
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in columns), F.lit(0))
    target = F.col(equals_column) if equals_column else F.lit(equals_value)
    return Check("multi_column_sum", lambda df: [Measure("multi_column_sum", ",".join(columns), "sum_mismatch", count_if(F.abs(total - target) > tolerance))])


def multi_column_calculation(left_column: str, op: str, right_column: str, equals_column: str | None = None, equals_value: float | None = None, tolerance: float = 0.001) -> Check:
    a, b = F.col(left_column), F.col(right_column)
    value = {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[op]
    target = F.col(equals_column) if equals_column else F.lit(equals_value)
    return Check("multi_column_calculation", lambda df: [Measure("multi_column_calculation", f"{left_column}{op}{right_column}", "calculation_mismatch", count_if(F.abs(value - target) > tolerance))])


def referential_integrity(column: str, reference: DataFrame, reference_column: str | None = None, name: str = "referential_integrity") -> Check:
    """Rows whose non-null value isn't in the reference: an outer join with its distinct values."""

    def plan(df: DataFrame) -> DataFrame:
        known = reference.select(F.col(reference_column or column).alias("__known")).where("__known is not null").distinct()
        child = df.select(F.col(column).alias("__v"))
        one = child.join(known, child["__v"] == known["__known"], "left").agg(count_if(F.col("__v").isNotNull() & F.col("__known").isNull()).alias("bad"), F.count("__v").alias("total"))
        return graded(one, name, column, "foreign_key_violation", F.col("bad"), F.col("total"))

    return Check(name, plan)


def streaming_referential_integrity(column: str, reference: DataFrame, reference_column: str | None = None) -> Check:
    """The same over counts of distinct values, so that what is joined is small."""

    def plan(df: DataFrame) -> DataFrame:
        known = reference.select(F.col(reference_column or column).alias("__known")).where("__known is not null").distinct()
        counts = df.groupBy(F.col(column).alias("__v")).agg(rows().alias("n"))
        one = counts.join(known, counts["__v"] == known["__known"], "left").agg(F.sum(F.when(F.col("__v").isNotNull() & F.col("__known").isNull(), F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("__v").isNotNull(), F.col("n")).otherwise(0)).alias("total"))
        return graded(one, "streaming_referential_integrity", column, "foreign_key_violation", F.col("bad"), F.col("total"))

    return Check("streaming_referential_integrity", plan)


def schema_contract(expected: Mapping[str, Mapping[str, object]]) -> Check:
    """Column rules from a learned or written schema: ``type``, ``nullable``, ``unique``, ``min``, ``max``, ``min_length``, ``max_length``, ``allowed``, ``pattern``."""

    def plan(df: DataFrame) -> DataFrame:
        from ..plans.checks import fused

        found = schema_found(df, {c: str(r.get("type", "")) for c, r in expected.items()}, True, False, False)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        found += [(c, "type_mismatch") for c, r in expected.items() if c in kinds and r.get("type") and not type_fits(kinds[c], str(r["type"]))]
        made: list[Measure] = []
        for c, r in expected.items():
            if c not in kinds:
                continue
            x = F.col(c)
            rules = {
                "null_violation": count_if(x.isNull()) if r.get("nullable") is False else None,
                "unique_violation": F.count(x) - F.count_distinct(x) if r.get("unique") else None,
                "below_min": count_if(x < r["min"]) if r.get("min") is not None else None,
                "above_max": count_if(x > r["max"]) if r.get("max") is not None else None,
                "too_short": count_if(F.char_length(x) < r["min_length"]) if r.get("min_length") is not None else None,
                "too_long": count_if(F.char_length(x) > r["max_length"]) if r.get("max_length") is not None else None,
                "not_allowed": count_if(~x.isin(list(r["allowed"]))) if r.get("allowed") else None,
                "pattern_mismatch": count_if(~x.rlike(f"^(?:{r['pattern']})")) if r.get("pattern") else None,
            }
            made += [Measure("schema", c, k, bad) for k, bad in rules.items() if bad is not None]
        out = literal_rows(df, "schema", found)
        return out.unionByName(fused(df, made)) if made else out

    return Check("schema", plan)


def table_freshness(timestamp_column: str, max_age: timedelta, now: datetime | None = None) -> Check:
    clock = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    age = (F.unix_micros(clock) - F.unix_micros(F.max(F.col(timestamp_column).cast("timestamp")))) / 6e7
    return Check("table_freshness", lambda df: [_number("table_freshness", timestamp_column, "stale_table", age, None, max_age.total_seconds() / 60)])


def table_data_recency(timestamp_column: str, max_age_days: float, min_recent_ratio: float = 0.5, now: datetime | None = None) -> Check:
    clock = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    recent = count_if(F.col(timestamp_column).cast("timestamp") >= clock - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_days * 86400)))
    return Check("table_data_recency", lambda df: [_number("table_data_recency", timestamp_column, "too_few_recent_rows", F.try_divide(recent, rows()), min_recent_ratio, None, "medium")])


def table_update_frequency(timestamp_column: str, expected_frequency: str = "day", max_gaps: int = 0) -> Check:
    """Missing hours, days or weeks between the first and the last timestamp."""
    part = F.date_trunc(expected_frequency, F.col(timestamp_column))
    unit = {"hour": 3600, "day": 86400, "week": 604800}[expected_frequency]
    span = (F.unix_seconds(F.max(part).cast("timestamp")) - F.unix_seconds(F.min(part).cast("timestamp"))) / unit
    gaps = F.round(span) + 1 - F.count_distinct(part)
    return Check("table_update_frequency", lambda df: [_number("table_update_frequency", timestamp_column, "update_gaps", gaps, None, max_gaps, "medium")])


def table_row_count_exact(expected_rows: int, tolerance: int = 0) -> Check:
    return row_count(expected_rows - tolerance, expected_rows + tolerance, name="table_row_count_exact")


def table_row_count_compare(reference: DataFrame, comparison: str = "equal", tolerance_ratio: float = 0.0) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        both = df.agg(rows().alias("a")).crossJoin(reference.agg(rows().alias("b")))
        slack = F.floor(F.col("b") * tolerance_ratio)
        ok = {"equal": F.abs(F.col("a") - F.col("b")) <= slack, "greater": F.col("a") > F.col("b") - slack, "less": F.col("a") < F.col("b") + slack, "greater_equal": F.col("a") >= F.col("b") - slack, "less_equal": F.col("a") <= F.col("b") + slack}
        return graded(both, "table_row_count_compare", "*", "row_count_mismatch", F.when(ok[comparison], 0).otherwise(1), F.lit(1), F.col("a"), grade="high")

    return Check("table_row_count_compare", plan)


def table_not_empty() -> Check:
    """Looks at one row only."""

    def plan(df: DataFrame) -> DataFrame:
        one = df.limit(1).agg(rows().alias("n"))
        return graded(one, "table_not_empty", "*", "empty_table", F.when(F.col("n") == 0, 1).otherwise(0), F.lit(1), F.col("n"), grade="critical")

    return Check("table_not_empty", plan)


def table_memory_size(max_bytes: float | None = None, min_bytes: float | None = None) -> Check:
    """Bytes of the values: fixed widths by type, and the bytes of texts."""

    def plan(df: DataFrame) -> list[Measure]:
        widths = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1, "date": 4}
        fixed = sum(widths.get(t, 8) for _, t in df.dtypes if t != "string")
        texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, t in df.dtypes if t == "string"]
        return [_number("table_memory_size", "*", "memory_size", sum(texts, rows() * fixed), min_bytes, max_bytes, "medium")]

    return Check("table_memory_size", plan)


def table_row_column_ratio(min_ratio: float | None = None, max_ratio: float | None = None) -> Check:
    return Check("table_row_column_ratio", lambda df: [_number("table_row_column_ratio", "*", "row_column_ratio", rows() / len(df.columns), min_ratio, max_ratio, "low")])


def table_dimensions(min_rows: int | None = None, max_rows: int | None = None, min_cols: int | None = None, max_cols: int | None = None) -> Check:
    return Check("table_dimensions", lambda df: [_number("table_dimensions", "rows", "row_count", rows(), min_rows, max_rows), _number("table_dimensions", "columns", "column_count", F.max(F.lit(len(df.columns))), min_cols, max_cols)])
