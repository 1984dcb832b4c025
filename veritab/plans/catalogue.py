"""The registered queries over the test tables: each operator on a table, and the same in SQL.

The test tables hold no nulls, orphans or malformed values, so many queries run over a `SOURCES` text, plain SQL that makes such rows from a test table. An entry's SQL gives
a check's numbers directly; severities are added by the same scale as the check's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from .checks import DUPLICATES, RANGES, STRICT, USUAL, Check, run
from .entries_checks import CHECKS, FLAGSHIP
from .entries_more import MORE_SQL, MORE_TABLES
from .entries_tables import TABLES
from .sources_sql import SOURCES, TEST_TABLES

Query = Callable[[SparkSession, str], DataFrame]
__all__ = ["DUPLICATES", "RANGES", "STRICT", "USUAL", "flagship", "oracle_sql", "queries"]


class Tables:
    """The test tables of a folder, and the made-up sources, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name in TEST_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = SOURCES[name]
        used = {t: self[t] for t in (*TEST_TABLES, *SOURCES) if f"{{{t}}}" in text}
        return self.spark.sql(text, **used)


def sql_source(name: str) -> str:
    """A source as a FROM item of plain SQL."""
    if name in TEST_TABLES:
        return name
    text = SOURCES[name]
    for t in (*TEST_TABLES, *SOURCES):
        if f"{{{t}}}" in text:
            text = text.replace(f"{{{t}}}", sql_source(t))
    return f"({text}) AS {name}_"


def _level(grade: tuple | str, at_least: bool) -> str:
    if isinstance(grade, str):
        return grade if grade.startswith("CASE ") else f"'{grade}'"
    share, op = "n_bad::DOUBLE / n_rows", ">=" if at_least else ">"
    return f"CASE WHEN n_rows = 0 OR {share} {op} {grade[0]} THEN 'critical' WHEN {share} {op} {grade[1]} THEN 'high' WHEN {share} {op} {grade[2]} THEN 'medium' ELSE 'low' END"


def check_sql(source: str, rows: Sequence[tuple], limit: float = 0.0, grade: tuple | str = USUAL, at_least: bool = False) -> str:
    """SQL of a check's results. A row is (check, column, issue, bad, total, actual): the last three are SQL aggregates over the source, or scalar queries with ``{source}``."""
    at = sql_source(source)
    parts = []
    for check, column, issue, bad, *more in rows:
        total = more[0] if more else "count(*)"
        actual = more[1] if len(more) > 1 else "NULL"
        own = more[2] if len(more) > 2 else grade
        inner = f"SELECT coalesce(({bad.replace('{source}', at)})::BIGINT, 0) AS n_bad, coalesce(({total.replace('{source}', at)})::BIGINT, 0) AS n_rows, round(({actual.replace('{source}', at)})::DOUBLE, 4) AS actual, count(*) AS all_rows FROM {at}"
        parts.append(
            f"SELECT '{check}' AS check_name, '{column}' AS column_name, '{issue}' AS issue, n_bad, n_rows, actual, "
            f"CASE WHEN n_bad > 0 AND n_bad > {limit} * n_rows THEN {_level(own, at_least)} END AS severity FROM ({inner}) AS q_"
        )
    sql = " UNION ALL ".join(parts)
    for t in SOURCES:
        sql = sql.replace(f"{{{t}}}", sql_source(t)) if f"{{{t}}}" in sql else sql
    return sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite over lineitem whose measures are all answered by one scan and one aggregation, and a key check."""
    from ..operators import completeness, distribution, uniqueness

    suite = [completeness.null(), completeness.not_null(), distribution.between("l_discount", 0, 0.1), distribution.positive("l_quantity"), uniqueness.compound_key(["l_orderkey", "l_linenumber"])]
    return run(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), suite)


def _check_query(source: str, make: Callable[[Tables], Check]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = Tables(spark, sf_dir)
        return run(tables[source], [make(tables)])

    return query


def _table_query(make: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: make(Tables(spark, sf_dir))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {name: _check_query(source, make) for name, source, make, *_ in CHECKS}
    out |= {name: _table_query(make) for name, make, _ in [*TABLES, *MORE_TABLES]}
    out["flagship_suite"] = flagship
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: check_sql(source, rows, **(rest[0] if rest else {})) for name, source, _, rows, *rest in CHECKS if rows}
    texts = {name: sql for name, _, sql in [*TABLES, *MORE_TABLES] if sql} | MORE_SQL
    for name, sql in texts.items():
        for t in SOURCES:
            sql = sql.replace(f"{{{t}}}", sql_source(t))
        out[name] = sql
    out["flagship_suite"] = check_sql("lineitem", FLAGSHIP)
    return out


#: The time that checks against the clock take for now.
NOW = datetime(2024, 1, 31)
