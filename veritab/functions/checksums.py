"""Check digits as column expressions: each takes a text column and tells whether it is valid; null stays null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# IBAN lengths by country.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
# VAT number patterns by country; Greece writes EL.
VAT_PATTERNS = {"AT": r"U\d{8}", "BE": r"[01]\d{9}", "BG": r"\d{9,10}", "CY": r"\d{8}[A-Z]", "CZ": r"\d{8,10}", "DE": r"\d{9}", "DK": r"\d{8}", "EE": r"\d{9}", "EL": r"\d{9}", "ES": r"[A-Z0-9]\d{7}[A-Z0-9]", "FI": r"\d{8}", "FR": r"[A-HJ-NP-Z0-9]{2}\d{9}", "GB": r"(\d{9}|\d{12}|GD\d{3}|HA\d{3})", "HR": r"\d{11}", "HU": r"\d{8}", "IE": r"\d[A-Z0-9+*]\d{5}[A-Z]{1,2}", "IT": r"\d{11}", "LT": r"(\d{9}|\d{12})", "LU": r"\d{8}", "LV": r"\d{11}", "MT": r"\d{8}", "NL": r"\d{9}B\d{2}", "PL": r"\d{10}", "PT": r"\d{9}", "RO": r"\d{2,10}", "SE": r"\d{12}", "SI": r"\d{8}", "SK": r"\d{10}"}
# Prefixes and lengths of payment cards.
CARDS = {"visa": r"4(\d{12}|\d{15}|\d{18})", "mastercard": r"(5[1-5]\d{14}|2(22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12})", "amex": r"3[47]\d{13}", "discover": r"6(011\d{12}|5\d{14}|4[4-9]\d{13})", "diners": r"3(0[0-5]|[68]\d)\d{11}", "jcb": r"35(2[89]|[3-8]\d)\d{12}", "unionpay": r"62\d{14,17}"}
# Weights and letters of the identification numbers.
CHINESE_WEIGHTS, CHINESE_MARKS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"
CHINESE_PROVINCES = "11,12,13,14,15,21,22,23,31,32,33,34,35,36,37,41,42,43,44,45,46,50,51,52,53,54,61,62,63,64,65,71,81,82".split(",")
USCC_LETTERS, USCC_WEIGHTS = "0123456789ABCDEFGHJKLMNPQRTUWXY", (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
MY_NUMBER_WEIGHTS = (6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
BUSINESS_WEIGHTS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def digits(x: Column) -> Column:
    """Without spaces and hyphens."""
    return F.regexp_replace(x, r"[\s-]", "")


def digit(x: Column, place: int) -> Column:
    """The number at a place, from 1; null where it isn't one."""
    return F.try_to_number(F.substring(x, place, 1), F.lit("9")).cast("int")


def weighted(x: Column, weights: Sequence[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(x, i + 1) * w
    return total


def luhn(x: Column) -> Column:
    """Mod 10 over the digits from the right, every second doubled."""
    d = F.transform(F.split(F.reverse(x), ""), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v)))
    total = F.aggregate(doubled, F.lit(0), lambda a, v: a + v)
    return F.when(x.rlike(r"^\d+\z"), total % 10 == 0).otherwise(F.when(x.isNotNull(), False))


def isbn(x: Column) -> Column:
    s = F.upper(digits(x))
    ten = F.lit(0)
    for i in range(9):
        ten = ten + digit(s, i + 1) * (10 - i)
    ten = ten + F.when(F.substring(s, 10, 1) == "X", 10).otherwise(digit(s, 10))
    thirteen = weighted(s, (1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1))
    return F.when(s.rlike(r"^\d{9}[\dX]\z"), ten % 11 == 0).when(s.rlike(r"^97[89]\d{10}\z"), thirteen % 10 == 0).otherwise(F.when(s.isNotNull(), False))


def iban(x: Column) -> Column:
    """Country length, then the rearranged number, letters as 10 to 35, mod 97."""
    s = F.upper(digits(x))
    length = F.create_map(*[F.lit(v) for kv in IBAN_LENGTHS.items() for v in kv])
    moved = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97)
    good = s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]+\z") & (F.length(s) == F.coalesce(F.try_element_at(length, F.substring(s, 1, 2)), F.lit(0))) & (rest == 1)
    return F.when(s.isNotNull(), good)


def vat(x: Column) -> Column:
    s = F.upper(F.regexp_replace(x, r"[\s.-]", ""))
    country = F.when(F.substring(s, 1, 2) == "GR", "EL").otherwise(F.substring(s, 1, 2))
    rest, good = F.substring(s, 3, 20), F.lit(False)
    for code, pattern in VAT_PATTERNS.items():
        good = good | ((country == code) & rest.rlike(rf"^{pattern}\z"))
    return F.when(s.isNotNull(), good)


def swift(x: Column, countries: Sequence[str] | None = None) -> Column:
    s = F.upper(F.trim(x))
    good = s.rlike(r"^[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?\z")
    return good & F.substring(s, 5, 2).isin(list(countries)) if countries else good


def card(x: Column, brands: Sequence[str] | None = None) -> Column:
    s = digits(x)
    pattern = "|".join(CARDS[b] for b in brands or CARDS)
    return F.when(s.isNotNull(), s.rlike(rf"^({pattern})\z") & luhn(s))


def chinese_id(x: Column, allow_15: bool = True) -> Column:
    s = F.upper(digits(x))
    mark = F.substring(F.lit(CHINESE_MARKS), 1, 11)
    last = F.substring(s, 18, 1) == F.element_at(F.split(mark, ""), (weighted(s, CHINESE_WEIGHTS) % 11 + 1).cast("int"))
    long_day = F.try_to_timestamp(F.substring(s, 7, 8), F.lit("yyyyMMdd")).isNotNull()
    short_day = F.try_to_timestamp(F.concat(F.lit("19"), F.substring(s, 7, 6)), F.lit("yyyyMMdd")).isNotNull()
    province = F.substring(s, 1, 2).isin(CHINESE_PROVINCES)
    good = F.when(s.rlike(r"^\d{17}[\dX]\z"), province & long_day & last).when(s.rlike(r"^\d{15}\z"), F.lit(allow_15) & province & short_day).otherwise(False)
    return F.when(s.isNotNull(), good)


def chinese_uscc(x: Column) -> Column:
    s = F.upper(digits(x))
    total = F.lit(0)
    for i, w in enumerate(USCC_WEIGHTS):
        total = total + _place(s, i + 1) * w
    good = F.when(s.rlike(rf"^[{USCC_LETTERS}]{{18}}\z"), (31 - total % 31) % 31 == _place(s, 18)).otherwise(False)
    return F.when(s.isNotNull(), good)


def _place(s: Column, i: int) -> Column:
    letters = F.array(*[F.lit(c) for c in USCC_LETTERS])
    return F.array_position(letters, F.substring(s, i, 1)) - 1


def japanese_postal(x: Column, strict: bool = False) -> Column:
    s = F.translate(x, "０１２３４５６７８９－ー〒", "0123456789--")
    s = s if strict else F.regexp_replace(s, r"[\s-]", "")
    shaped = s.rlike(r"^\d{3}-\d{4}\z") if strict else s.rlike(r"^\d{7}\z")
    return F.when(x.isNotNull(), shaped & (F.substring(s, 1, 3) >= "001") & (F.substring(s, 1, 3) <= "999"))


def my_number(x: Column) -> Column:
    s = digits(x)
    rest = weighted(s, MY_NUMBER_WEIGHTS) % 11
    return F.when(s.rlike(r"^\d{12}\z"), F.when(rest <= 1, 0).otherwise(11 - rest) == digit(s, 12)).otherwise(F.when(s.isNotNull(), False))


def korean_business(x: Column) -> Column:
    s = digits(x)
    total = weighted(s, BUSINESS_WEIGHTS) + F.floor(digit(s, 9) * 5 / 10)
    return F.when(s.rlike(r"^\d{10}\z"), (10 - total % 10) % 10 == digit(s, 10)).otherwise(F.when(s.isNotNull(), False))


def korean_rrn(x: Column) -> Column:
    s = digits(x)
    month, day = F.substring(s, 3, 2).cast("int"), F.substring(s, 5, 2).cast("int")
    good = (11 - weighted(s, RRN_WEIGHTS) % 11) % 10 == digit(s, 13)
    return F.when(s.rlike(r"^\d{6}[0-9]\d{6}\z"), good & month.between(1, 12) & day.between(1, 31)).otherwise(F.when(s.isNotNull(), False))
