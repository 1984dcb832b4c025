"""Dates and times: formats, freshness, coverage, order and ranges. Checks against the clock take ``now``, the current time if not given."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checks import Check, Measure, count_if, graded, literal_rows, outside, per_column, rows

# Strptime directives and the pattern letters that stand for them.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%f": "SSSSSS", "%p": "a", "%I": "hh", "%z": "xx", "%j": "DDD", "%a": "EEE", "%A": "EEEE", "%T": "HH:mm:ss", "%F": "yyyy-MM-dd"}
# Formats that are tried for dates of unknown form.
COMMON_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "dd-MM-yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MM-dd-yyyy", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "HH:mm:ss", "HH:mm")


def java_pattern(strptime: str) -> str:
    out, i = "", 0
    while i < len(strptime):
        two = strptime[i : i + 2]
        if two in DIRECTIVES:
            out, i = out + DIRECTIVES[two], i + 2
        else:
            out, i = out + (f"'{strptime[i]}'" if strptime[i].isalpha() else strptime[i]), i + 1
    return out


def _now(now: datetime | None) -> Column:
    return F.lit(now) if now is not None else F.current_timestamp()


def date_format(columns: str | Sequence[str] | None = None, format: str = "%Y-%m-%d") -> Check:
    pattern = java_pattern(format)
    return per_column("date_format", columns, "string", lambda c, x: Measure("date_format", c, "invalid_date_format", count_if(x.isNotNull() & F.try_to_timestamp(x, F.lit(pattern)).isNull()), F.count(x)))


def recent_data(column: str, max_age_hours: float = 24.0, now: datetime | None = None) -> Check:
    """Age, in hours, of the latest value; critical beyond twice the limit."""
    age = (F.unix_micros(_now(now).cast("timestamp")) - F.unix_micros(F.max(F.col(column).cast("timestamp")))) / 3.6e9

    def plan(df: DataFrame) -> DataFrame:
        one = df.agg(age.alias("age"))
        out = graded(one, "recent_data", column, "stale_data", outside(F.col("age"), None, max_age_hours), F.lit(1), F.col("age"), grade="high")
        return out.withColumn("severity", F.when(F.col("severity").isNotNull(), F.when(F.col("actual") > 2 * max_age_hours, "critical").otherwise("high")))

    return Check("recent_data", plan)


def date_part_coverage(column: str, date_part: str = "day", min_coverage: float = 1.0) -> Check:
    """Share of the hours, days, weeks or months between the first and the last value in which there is a value."""
    part = F.date_trunc(date_part, F.col(column))
    first, last = F.min(part), F.max(part)
    span = {
        "hour": (F.unix_seconds(last.cast("timestamp")) - F.unix_seconds(first.cast("timestamp"))) / 3600,
        "day": F.datediff(last, first),
        "week": F.datediff(last, first) / 7,
        "month": F.months_between(F.trunc(last, "month"), F.trunc(first, "month")),
        "year": F.year(last) - F.year(first),
    }[date_part]
    share = F.count_distinct(part) / (F.round(span) + 1)
    return Check("date_part_coverage", lambda df: [Measure("date_part_coverage", column, "incomplete_coverage", outside(share, min_coverage, None), F.lit(1), share, grade="medium")])


def grouped_recent_data(datetime_column: str, group_column: str, max_age_hours: float = 24.0, now: datetime | None = None) -> Check:
    """Groups whose latest value is too old, or missing."""

    def plan(df: DataFrame) -> DataFrame:
        cutoff = _now(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_hours * 3600))
        last = df.groupBy(group_column).agg(F.max(F.col(datetime_column).cast("timestamp")).alias("last"))
        one = last.agg(count_if(F.col("last").isNull() | (F.col("last") < cutoff)).alias("bad"), rows().alias("total"))
        return graded(one, "grouped_recent_data", group_column, "stale_group", F.col("bad"), F.col("total"))

    return Check("grouped_recent_data", plan)


def date_order(first_column: str, second_column: str, allow_equal: bool = True) -> Check:
    a, b = F.col(first_column), F.col(second_column)
    return Check("date_order", lambda df: [Measure("date_order", f"{first_column},{second_column}", "invalid_date_order", count_if(a > b if allow_equal else a >= b), count_if(a.isNotNull() & b.isNotNull()))])


def dateutil_parseable(column: str, fuzzy: bool = False) -> Check:
    """Values that no common format parses; ``fuzzy`` looks for a date anywhere in the text, by an Arrow-batched function over what the formats leave."""

    def plan(df: DataFrame) -> DataFrame:
        x = F.trim(F.col(column))
        parsed = F.coalesce(*[F.try_to_timestamp(x, F.lit(f)) for f in COMMON_FORMATS])
        ok = parsed.isNotNull()
        if fuzzy:

            @F.pandas_udf("boolean")
            def within(values: pd.Series) -> pd.Series:
                found = values.str.extract(r"(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{1,2} [A-Za-z]{3,9} \d{4}|[A-Za-z]{3,9} \d{1,2},? \d{4})")[0]
                return found.notna()

            ok = ok | within(F.when(parsed.isNull(), x))
        one = df.select(F.col(column).alias("x"), ok.alias("ok")).agg(count_if(F.col("x").isNotNull() & ~F.col("ok")).alias("bad"), F.count("x").alias("total"))
        return graded(one, "dateutil_parseable", column, "unparseable_date", F.col("bad"), F.col("total"))

    return Check("dateutil_parseable", plan)


def date_between(columns: str | Sequence[str] | None = None, min_date: str | None = None, max_date: str | None = None) -> Check:
    def measure(c: str, x: Column) -> Measure:
        day, bad = F.to_date(x), F.lit(False)
        bad = bad | (day < F.lit(min_date).cast("date")) if min_date else bad
        bad = bad | (day > F.lit(max_date).cast("date")) if max_date else bad
        return Measure("date_between", c, "date_out_of_range", count_if(bad), F.count(x))

    return per_column("date_between", columns, "temporal", measure)


def future_date(columns: str | Sequence[str] | None = None, now: datetime | None = None) -> Check:
    return per_column("future_date", columns, "temporal", lambda c, x: Measure("future_date", c, "future_date", count_if(F.to_date(x) > F.to_date(_now(now))), F.count(x)))


def past_date(columns: str | Sequence[str] | None = None, min_date: str = "1900-01-01") -> Check:
    return per_column("past_date", columns, "temporal", lambda c, x: Measure("past_date", c, "date_too_old", count_if(F.to_date(x) < F.lit(min_date).cast("date")), F.count(x)))


def timezone(columns: str | Sequence[str] | None = None, expected_timezone: str | None = None, require_timezone: bool = True) -> Check:
    """Timestamps without a zone, or whose column metadata (``timezone``) names another than expected."""

    def plan(df: DataFrame) -> DataFrame:
        found = []
        for f in df.schema.fields:
            if not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) or columns and f.name not in ([columns] if isinstance(columns, str) else columns):
                continue
            if isinstance(f.dataType, T.TimestampNTZType) and require_timezone:
                found.append((f.name, "missing_timezone"))
            elif expected_timezone and f.metadata.get("timezone", df.sparkSession.conf.get("spark.sql.session.timeZone")) != expected_timezone:
                found.append((f.name, "unexpected_timezone"))
        return literal_rows(df, "timezone", found, "medium")

    return Check("timezone", plan)
