"""Text formats, patterns, lengths and casing. Null values pass everywhere; blank ones pass format checks."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.checks import Check, Measure, count_if, graded, per_column, rows

# Patterns of common formats.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
URL = r"(?i)^https?://[^\s/$.?#].[^\s]*\z"
PHONES = {
    "strict": r"^\+?[0-9]{1,4}?[-.\s]?\(?[0-9]{1,4}\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9}\z",
    "generic": r"^[+]?[(]?[0-9]{1,4}[)]?[-\s./0-9]{5,20}\z",
    "international": r"^\+[1-9][0-9]{6,14}\z",
    "north_america": r"^(\+?1[-.\s]?)?\(?[2-9][0-9]{2}\)?[-.\s]?[2-9][0-9]{2}[-.\s]?[0-9]{4}\z",
    "korea": r"^(\+82[-.\s]?|0)1[016789][-.\s]?[0-9]{3,4}[-.\s]?[0-9]{4}\z",
}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
# Fixed value: four numbers from 0 to 255, which may have leading zeros.
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\z"
IPV6 = r"(?i)^(([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(([0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4})?::(([0-9a-f]{1,4}:){0,6}[0-9a-f]{1,4})?)\z"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
CODE = r"^[A-Z0-9_-]+\z"
# Words in a column's name, and the format that its values should have; the first that fits holds.
NAMED_FORMATS = {"email": EMAIL, "phone": PHONES["generic"], "url": URL, "uuid": UUID, "ip": IPV4, "date": DATE, "code": CODE}


def blank(x: Column) -> Column:
    return ~x.rlike(r"(?U)\S")


def anchored(pattern: str, full: bool = True, dotall: bool = False, ignore_case: bool = False) -> str:
    """A pattern as a Java expression; ``full`` makes it match the whole value, its last line break included."""
    flags = ("s" if dotall else "") + ("i" if ignore_case else "")
    body = rf"^(?:{pattern})\z" if full else pattern
    return f"(?{flags}){body}" if flags else body


def _format(name: str, columns, pattern: str) -> Check:
    return per_column(name, columns, "string", lambda c, x: Measure(name, c, f"invalid_{name}", count_if(~blank(x) & ~x.rlike(pattern)), F.count(x)))


def email(columns: str | Sequence[str] | None = None) -> Check:
    return _format("email", columns, EMAIL)


def url(columns: str | Sequence[str] | None = None) -> Check:
    return _format("url", columns, URL)


def phone(columns: str | Sequence[str] | None = None, pattern: str = "strict") -> Check:
    return _format("phone", columns, PHONES[pattern])


def uuid(columns: str | Sequence[str] | None = None) -> Check:
    return _format("uuid", columns, UUID)


def ip_address(columns: str | Sequence[str] | None = None) -> Check:
    return _format("ip_address", columns, IPV4)


def ipv6_address(columns: str | Sequence[str] | None = None) -> Check:
    return _format("ipv6_address", columns, IPV6)


def named_format(columns: str | Sequence[str] | None = None) -> Check:
    """The format that a column's name tells; among its values that aren't blank."""

    def plan(df: DataFrame) -> list[Measure]:
        names = [columns] if isinstance(columns, str) else columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        found = [(c, next((p for k, p in NAMED_FORMATS.items() if k in c.lower()), None)) for c in names]
        return [Measure("format", c, "invalid_format", count_if(~blank(F.col(c)) & ~F.col(c).rlike(p)), count_if(~blank(F.col(c)))) for c, p in found if p]

    return Check("format", plan)


def casing(x: Column) -> Column:
    """upper, lower, title or mixed; null where there is no letter."""
    letters = F.regexp_replace(x, r"\P{L}", "")
    title = ~x.rlike(r"\p{L}\p{Lu}") & ~x.rlike(r"(^|\P{L})\p{Ll}")
    return F.when(letters == "", None).when(x == F.upper(x), "upper").when(x == F.lower(x), "lower").when(title, "title").otherwise("mixed")


def consistent_casing(columns: str | Sequence[str] | None = None, expected_casing: str | None = None) -> Check:
    """Values of another casing than expected; without an expectation, those outside the commonest of upper, lower and title."""

    def measure(c: str, x: Column) -> Measure:
        kind = casing(x)
        if expected_casing:
            return Measure("consistent_casing", c, "inconsistent_casing", count_if(kind != expected_casing), F.count(x))
        each = [count_if(kind == k) for k in ("upper", "lower", "title")]
        return Measure("consistent_casing", c, "inconsistent_casing", each[0] + each[1] + each[2] - F.greatest(*each), F.count(x))

    return per_column("consistent_casing", columns, "string", measure)


def alphanumeric(columns: str | Sequence[str] | None = None, allow_underscore: bool = False, allow_hyphen: bool = False, allow_space: bool = False) -> Check:
    extra = ("_" if allow_underscore else "") + (r"\s" if allow_space else "") + ("-" if allow_hyphen else "")
    return per_column("alphanumeric", columns, "string", lambda c, x: Measure("alphanumeric", c, "non_alphanumeric", count_if(~x.rlike(rf"^[a-zA-Z0-9{extra}]*\z")), F.count(x)))


def json_parseable(columns: str | Sequence[str] | None = None) -> Check:
    """Values that aren't JSON, by the variant parser."""
    return per_column("json_parseable", columns, "string", lambda c, x: Measure("json_parseable", c, "invalid_json", count_if(x.isNotNull() & F.try_parse_json(x).isNull()), F.count(x)))


def _fits(value: object, schema: dict) -> bool:
    """The parts of JSON Schema that don't refer elsewhere: type, enum, const, bounds, lengths, pattern, items, properties, required, additionalProperties, all/any/one/not."""
    import re

    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def is_kind(k: str) -> bool:
        if k in ("number", "integer"):
            number = isinstance(value, (int, float)) and not isinstance(value, bool)
            return number and (k == "number" or float(value).is_integer())
        return isinstance(value, kinds[k])

    kind = schema.get("type")
    if kind is not None and not any(map(is_kind, [kind] if isinstance(kind, str) else kind)):
        return False
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return False
    if is_kind("number"):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return False
        if value <= schema.get("exclusiveMinimum", float("-inf")) or value >= schema.get("exclusiveMaximum", float("inf")):
            return False
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)) or "pattern" in schema and not re.search(schema["pattern"], value):
            return False
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)) or "items" in schema and not all(_fits(v, schema["items"]) for v in value):
            return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or any(k in value and not _fits(value[k], s) for k, s in known.items()):
            return False
        rest = schema.get("additionalProperties", True)
        if rest is not True and any(rest is False or not _fits(v, rest) for k, v in value.items() if k not in known):
            return False
    return (
        all(_fits(value, s) for s in schema.get("allOf", ()))
        and ("anyOf" not in schema or any(_fits(value, s) for s in schema["anyOf"]))
        and ("oneOf" not in schema or sum(_fits(value, s) for s in schema["oneOf"]) == 1)
        and ("not" not in schema or not _fits(value, schema["not"]))
    )


def json_schema(column: str, schema: dict) -> Check:
    """Values that aren't JSON or don't fit the schema, by an Arrow-batched function."""

    @F.pandas_udf("boolean")
    def fits(values: pd.Series) -> pd.Series:
        def one(text: str | None) -> bool | None:
            if text is None:
                return None
            try:
                return _fits(json.loads(text), schema)
            except ValueError:
                return False

        return values.map(one).astype("object")

    def plan(df: DataFrame) -> DataFrame:
        one = df.select(F.col(column).alias("x"), fits(column).alias("ok")).agg(count_if(~F.col("ok")).alias("bad"), F.count("x").alias("total"))
        return graded(one, "json_schema", column, "json_schema_violation", F.col("bad"), F.col("total"))

    return Check("json_schema", plan)


def length(columns: str | Sequence[str] | None = None, min_length: int | None = None, max_length: int | None = None, exact_length: int | None = None) -> Check:
    def measure(c: str, x: Column) -> Measure:
        n, bad = F.char_length(x), F.lit(False)
        if exact_length is not None:
            bad = n != exact_length
        else:
            bad = bad | (n < min_length) if min_length is not None else bad
            bad = bad | (n > max_length) if max_length is not None else bad
        return Measure("length", c, "invalid_length", count_if(bad), rows())

    return per_column("length", columns, "string", measure)


def like_pattern(pattern: str, columns: str | Sequence[str] | None = None, case_sensitive: bool = True) -> Check:
    return per_column("like_pattern", columns, "string", lambda c, x: Measure("like_pattern", c, "like_mismatch", count_if(~(x.like(pattern) if case_sensitive else x.ilike(pattern))), F.count(x)))


def not_like_pattern(pattern: str, columns: str | Sequence[str] | None = None, case_sensitive: bool = True) -> Check:
    return per_column("not_like_pattern", columns, "string", lambda c, x: Measure("not_like_pattern", c, "like_match", count_if(x.like(pattern) if case_sensitive else x.ilike(pattern)), F.count(x)))


def regex(pattern: str, columns: str | Sequence[str] | None = None, match_full: bool = True, dotall: bool = True, case_insensitive: bool = False) -> Check:
    p = anchored(pattern, match_full, dotall, case_insensitive)
    return per_column("regex", columns, "string", lambda c, x: Measure("regex", c, "regex_mismatch", count_if(~blank(x) & ~x.rlike(p)), F.count(x)))


def regex_list(patterns: Sequence[str], columns: str | Sequence[str] | None = None, match_mode: str = "any", match_full: bool = True) -> Check:
    def measure(c: str, x: Column) -> Measure:
        hits = [x.rlike(anchored(p, match_full)) for p in patterns]
        return Measure("regex_list", c, "regex_list_mismatch", count_if(~reduce(or_ if match_mode == "any" else and_, hits)), F.count(x))

    return per_column("regex_list", columns, "string", measure)


def not_match_regex(pattern: str, columns: str | Sequence[str] | None = None, match_full: bool = False) -> Check:
    p = anchored(pattern, match_full)
    return per_column("not_match_regex", columns, "string", lambda c, x: Measure("not_match_regex", c, "forbidden_pattern", count_if(x.rlike(p)), F.count(x)))


def not_match_regex_list(patterns: Sequence[str], columns: str | Sequence[str] | None = None, match_full: bool = False, case_insensitive: bool = True) -> Check:
    p = anchored("|".join(f"(?:{x})" for x in patterns), match_full, ignore_case=case_insensitive)
    return per_column("not_match_regex_list", columns, "string", lambda c, x: Measure("not_match_regex_list", c, "forbidden_pattern", count_if(x.rlike(p)), F.count(x)))
