"""Numbers with check digits, and national formats."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums as k
from ..plans.checks import RANGES, Check, Measure, count_if

# Digits in account numbers by bank.
KOREAN_BANKS = {"kb": (12, 14), "shinhan": (11, 12), "woori": (13, 13), "hana": (14, 14), "nh": (11, 14), "ibk": (10, 14), "kakao": (13, 13), "toss": (12, 12)}


def _valid(name: str, column: str, good: Callable[[Column], Column]) -> Check:
    x = F.nullif(F.trim(F.col(column).cast("string")), F.lit(""))
    return Check(name, lambda df: [Measure(name, column, f"invalid_{name}", count_if(~good(x)), F.count(x), grade=RANGES, at_least=True)])


def luhn(column: str, min_length: int = 1, max_length: int = 19, allowed_prefixes: Sequence[str] | None = None) -> Check:
    def good(x: Column) -> Column:
        s = k.digits(x)
        ok = k.luhn(s) & F.length(s).between(min_length, max_length)
        return ok & s.rlike("^(" + "|".join(allowed_prefixes) + ")") if allowed_prefixes else ok

    return _valid("luhn", column, good)


def isbn(column: str) -> Check:
    return _valid("isbn", column, k.isbn)


def credit_card(column: str, allowed_brands: Sequence[str] | None = None) -> Check:
    return _valid("credit_card", column, lambda x: k.card(x, allowed_brands))


def iban(column: str) -> Check:
    return _valid("iban", column, k.iban)


def vat(column: str) -> Check:
    return _valid("vat", column, k.vat)


def swift(column: str, allowed_countries: Sequence[str] | None = None) -> Check:
    return _valid("swift", column, lambda x: k.swift(x, allowed_countries))


def chinese_id(column: str, allow_15_digit: bool = True) -> Check:
    return _valid("chinese_id", column, lambda x: k.chinese_id(x, allow_15_digit))


def chinese_uscc(column: str) -> Check:
    return _valid("chinese_uscc", column, k.chinese_uscc)


def japanese_postal_code(column: str, strict_format: bool = False) -> Check:
    return _valid("japanese_postal_code", column, lambda x: k.japanese_postal(x, strict_format))


def japanese_my_number(column: str) -> Check:
    return _valid("japanese_my_number", column, k.my_number)


def korean_business_number(column: str) -> Check:
    return _valid("korean_business_number", column, k.korean_business)


def korean_rrn(column: str) -> Check:
    return _valid("korean_rrn", column, k.korean_rrn)


def korean_phone(column: str, allow_mobile: bool = True, allow_landline: bool = True, allow_special: bool = True) -> Check:
    kinds = ([r"01[016789]\d{7,8}"] if allow_mobile else []) + ([r"0(2|[3-6][1-5])\d{7,8}"] if allow_landline else []) + ([r"(15|16|18)\d{6}", r"0[5-8]0\d{7,8}"] if allow_special else [])
    return _valid("korean_phone", column, lambda x: F.regexp_replace(F.regexp_replace(x, r"[\s().-]", ""), r"^\+82", "0").rlike("^(" + "|".join(kinds) + r")\z"))


def korean_bank_account(column: str, bank_column: str | None = None, bank_code: str | None = None, banks: Mapping[str, tuple[int, int]] = KOREAN_BANKS) -> Check:
    def good(x: Column) -> Column:
        n, bank = F.length(k.digits(x)), F.col(bank_column) if bank_column else F.lit(bank_code)
        fits = F.lit(False)
        for name, (low, high) in banks.items():
            fits = fits | ((bank == name) & n.between(low, high))
        return k.digits(x).rlike(r"^\d+\z") & fits

    return _valid("korean_bank_account", column, good)
