"""Profiles of tables, schemas learned from them, suites made from those, and comparison of two profiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import completeness, distribution, strings, uniqueness
from ..operators.quantiles import exact_quantiles
from .checks import NUMERIC, TEMPORAL, Check, count_if, rows

PROFILE = "column_name string, kind string, n_rows long, n_null long, n_distinct long, minimum string, maximum string, mean double, std double, q1 double, median double, q3 double, skewness double, kurtosis double, min_length int, max_length int, mean_length double, n_empty long"


def profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """One row for each column (see ``PROFILE``): a few aggregations of all columns. Exact distinct counts shuffle each column's values; with
    ``approximate``, they come from sketches of 1 % standard error, and quartiles from sketches whose ranks are off by 0.01 % at most."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    asked, distinct, sketched, ends, made = [rows().alias("n")], [], [], [], []
    for i, f in enumerate(fields):
        x, none = F.col(f"`{f.name}`"), F.lit(None)
        number, text, time = isinstance(f.dataType, NUMERIC), isinstance(f.dataType, T.StringType), isinstance(f.dataType, TEMPORAL)
        simple = number or text or time or isinstance(f.dataType, T.BooleanType)
        key = x if simple else F.to_json(x) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else x.cast("string")
        distinct.append((F.approx_count_distinct(key, 0.01) if approximate else F.count_distinct(key)).alias(f"distinct{i}"))
        if number and approximate:
            sketched.append(F.percentile_approx(x.cast("double"), [0.25, 0.5, 0.75], 10_000).alias(f"q{i}"))
        lowest, highest = (f(x).cast("string") if simple else none.cast("string") for f in (F.min, F.max))
        (ends if text else asked).extend([lowest.alias(f"min{i}"), highest.alias(f"max{i}")])
        values = {
            "null": count_if(x.isNull()), "mean": F.avg(x) if number else none, "std": F.stddev_samp(x) if number else none,
            "skew": F.skewness(x) if number else none, "kurt": F.kurtosis(x) if number else none,
            "minl": F.min(F.char_length(x)) if text else none, "maxl": F.max(F.char_length(x)) if text else none, "meanl": F.avg(F.char_length(x)) if text else none, "empty": count_if(x == "") if text else none,
        }
        asked += [v.alias(f"{k}{i}") for k, v in values.items()]
        q, double = F.col(f"q{i}") if number else F.lit(None).cast("array<double>"), "double"
        made.append(
            F.struct(
                F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("kind"), F.col("n").alias("n_rows"), F.col(f"null{i}").alias("n_null"), F.col(f"distinct{i}").alias("n_distinct"),
                F.col(f"min{i}").alias("minimum"), F.col(f"max{i}").alias("maximum"), *[F.col(f"{k}{i}").cast(double).alias(a) for k, a in (("mean", "mean"), ("std", "std"))],
                q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), F.col(f"skew{i}").cast(double).alias("skewness"), F.col(f"kurt{i}").cast(double).alias("kurtosis"),
                F.col(f"minl{i}").cast("int").alias("min_length"), F.col(f"maxl{i}").cast("int").alias("max_length"), F.col(f"meanl{i}").cast(double).alias("mean_length"), F.col(f"empty{i}").cast("long").alias("n_empty"),
            )
        )
    exact = {f"q{i}": (F.col(f"`{f.name}`"), [0.25, 0.5, 0.75]) for i, f in enumerate(fields) if isinstance(f.dataType, NUMERIC)}
    # counts and moments are generated code only while no sketch, distinct count or text is beside them, so these are asked for apart; one row each
    one = reduce(DataFrame.crossJoin, [df.agg(*x) for x in (asked, distinct, sketched, ends) if x])
    one = one.crossJoin(exact_quantiles(df, exact)) if exact and not approximate else one
    return one.select(F.inline(F.array(*made)))


def learn(df: DataFrame, categorical_threshold: int = 20) -> dict[str, dict[str, object]]:
    """A schema contract (see `operators.schemas.schema_contract`) with types, nullability, uniqueness, bounds, lengths, and the values of columns with few of them."""
    seen = {r["column_name"]: r for r in profile(df).collect()}
    few = [c for c, r in seen.items() if r["kind"] == "string" and 0 < r["n_distinct"] <= categorical_threshold]
    sets = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
    out: dict[str, dict[str, object]] = {}
    for c, r in seen.items():
        rule: dict[str, object] = {"type": r["kind"], "nullable": r["n_null"] > 0, "unique": r["n_rows"] > 0 and r["n_distinct"] == r["n_rows"]}
        if r["mean"] is not None:
            rule |= {"min": float(r["minimum"]), "max": float(r["maximum"])}
        if r["max_length"] is not None:
            rule |= {"min_length": r["min_length"], "max_length": r["max_length"]}
        if c in few:
            rule["allowed"] = list(sets[c])
        out[c] = rule
    return out


def save_schema(schema: dict[str, dict[str, object]], df: DataFrame, path: str) -> None:
    """A learned schema as JSON text, wherever Spark can write."""
    import json

    df.sparkSession.createDataFrame([(json.dumps(schema, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_schema(df: DataFrame, path: str) -> dict[str, dict[str, object]]:
    import json

    return json.loads(df.sparkSession.read.text(path).first()[0])


def patterns(df: DataFrame, columns: Sequence[str] | None = None, min_ratio: float = 0.8) -> DataFrame:
    """``column_name, pattern, share`` of known formats that at least ``min_ratio`` of a text column's values have; one aggregation."""
    known = {"email": strings.EMAIL, "url": strings.URL, "uuid": strings.UUID, "ipv4": strings.IPV4, "date": strings.DATE, "integer": r"^-?\d+\z", "decimal": r"^-?\d+\.\d+\z", "code": strings.CODE, "json": r"(?s)^\s*[\[{].*[\]}]\s*\z", "percentage": r"^-?\d+(\.\d+)?%\z"}
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    pairs = [(c, k) for c in names for k in known]
    one = df.agg(*[F.try_divide(count_if(F.col(c).rlike(known[k])), F.count(c)).alias(f"s{i}") for i, (c, k) in enumerate(pairs)])
    found = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("pattern"), F.col(f"s{i}").alias("share")) for i, (c, k) in enumerate(pairs)])))
    return found.where(F.col("share") >= min_ratio)


def semantic_types(df: DataFrame, categorical_threshold: float = 0.05, identifier_threshold: float = 0.95) -> DataFrame:
    """``column_name, semantic``: identifier, categorical or plain, by the share of distinct values."""
    share = F.try_divide("n_distinct", F.col("n_rows") - F.col("n_null"))
    kind = F.when(share >= identifier_threshold, "identifier").when(share <= categorical_threshold, "categorical").otherwise("plain")
    return profile(df).select("column_name", kind.alias("semantic"))


def suite(df: DataFrame, strictness: float = 0.1) -> list[Check]:
    """Checks that the profiled table passes: nulls, uniqueness, ranges widened by ``strictness`` of their span, and few-valued sets."""
    made: list[Check] = []
    for c, r in learn(df).items():
        if not r["nullable"]:
            made.append(completeness.not_null(c))
        if r["unique"]:
            made.append(uniqueness.unique(c))
        if "min" in r:
            slack = strictness * (r["max"] - r["min"])
            made.append(distribution.between(c, r["min"] - slack, r["max"] + slack))
        if "allowed" in r:
            made.append(distribution.in_set(c, r["allowed"]))
        elif "max_length" in r:
            made.append(strings.length(c, r["min_length"], r["max_length"]))
    return made


def compare_profiles(before: DataFrame, after: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``column_name, aspect, was, now, drifted`` between two profiles: completeness, uniqueness, mean, minimum, maximum and cardinality; shares by difference, the others by
    relative change."""
    both = before.alias("a").join(after.alias("b"), "column_name")
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    aspects = {
        "completeness": (1 - F.try_divide(a("n_null"), a("n_rows")), 1 - F.try_divide(b("n_null"), b("n_rows")), False),
        "uniqueness": (F.try_divide(a("n_distinct"), a("n_rows")), F.try_divide(b("n_distinct"), b("n_rows")), False),
        "mean": (a("mean"), b("mean"), True),
        "minimum": (a("minimum").try_cast("double"), b("minimum").try_cast("double"), True),
        "maximum": (a("maximum").try_cast("double"), b("maximum").try_cast("double"), True),
        "cardinality": (a("n_distinct").cast("double"), b("n_distinct").cast("double"), True),
    }
    made = []
    for name, (x, y, relative) in aspects.items():
        change = F.try_divide(F.abs(y - x), F.abs(x)) if relative else F.abs(y - x)
        made.append(both.select("column_name", F.lit(name).alias("aspect"), x.cast("double").alias("was"), y.cast("double").alias("now"), F.coalesce(change > threshold, F.lit(False)).alias("drifted")).where("was is not null or now is not null"))
    return reduce(DataFrame.unionByName, made)


def correlations(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``a, b, r`` of numeric column pairs with a correlation of ``threshold`` or more; one aggregation."""
    from itertools import combinations

    names = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    pairs = list(combinations(names, 2))
    one = df.agg(*[F.corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    found = one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)])))
    return found.where(F.abs("r") >= threshold)


def functional_dependencies(df: DataFrame, pairs: Sequence[tuple[str, str]], min_confidence: float = 0.95) -> DataFrame:
    """``determinant, dependent, confidence``: the share of determinant values with one dependent value, null counting as one."""
    made = []
    for x, y in pairs:
        inner = df.groupBy(x, y).count().groupBy(x).agg(rows().alias("k"))
        made.append(inner.agg(F.try_divide(count_if(F.col("k") == 1), rows()).alias("confidence")).select(F.lit(x).alias("determinant"), F.lit(y).alias("dependent"), "confidence"))
    return reduce(DataFrame.unionByName, made).where(F.col("confidence") >= min_confidence)


def conditional_rules(df: DataFrame, antecedent: str, consequent: str, min_support: int = 10, min_confidence: float = 0.9) -> DataFrame:
    """``if_value, then_value, support, confidence`` of rules that a value of one column implies a value of another."""
    pairs = df.dropna(subset=[antecedent, consequent]).groupBy(antecedent, consequent).agg(rows().alias("support"))
    totals = pairs.groupBy(antecedent).agg(F.sum("support").alias("total"))
    joined = pairs.join(totals, antecedent).select(F.col(antecedent).alias("if_value"), F.col(consequent).alias("then_value"), "support", (F.col("support") / F.col("total")).alias("confidence"))
    return joined.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """``n_rows, n_duplicate``: rows beyond the first of each."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicate"))
