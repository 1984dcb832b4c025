"""Personal data: finding it, masking it, and rules about consent, retention and erasure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.checks import Check, Measure, count_if, literal_rows, pick
from . import strings

# Kinds of personal data: words in a column's name, a pattern of whole values ("" if only the name tells), and the laws that name the kind.
KINDS: dict[str, tuple[tuple[str, ...], str, tuple[str, ...]]] = {
    "email": (("email", "mail"), strings.EMAIL, ("gdpr", "ccpa", "lgpd", "pipeda", "appi")),
    "phone": (("phone", "mobile", "tel"), r"^\+?[0-9][0-9\s().-]{6,18}[0-9]\z", ("gdpr", "ccpa", "lgpd", "pipeda", "appi")),
    "us_ssn": (("ssn", "social_security"), r"^\d{3}-\d{2}-\d{4}\z", ("ccpa",)),
    "credit_card": (("card", "credit"), r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7}\z", ("gdpr", "ccpa", "lgpd", "pipeda", "appi", "pci_dss")),
    "ip_address": (("ip_addr", "ip_address"), strings.IPV4, ("gdpr", "ccpa")),
    "iban": (("iban",), r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}\z", ("gdpr",)),
    "korean_rrn": (("rrn", "resident"), r"^\d{6}-?[1-8]\d{6}\z", ("pipa",)),
    "cpf": (("cpf",), r"^\d{3}\.?\d{3}\.?\d{3}-?\d{2}\z", ("lgpd",)),
    "sin": (("sin", "social_insurance"), r"^\d{3}[\s-]\d{3}[\s-]\d{3}\z", ("pipeda",)),
    "my_number": (("my_number", "mynumber"), r"^\d{4}-?\d{4}-?\d{4}\z", ("appi",)),
    "passport": (("passport",), r"^[A-Z]{1,2}\d{6,9}\z", ("gdpr", "ccpa", "lgpd", "pipeda", "appi")),
    "name": (("first_name", "last_name", "full_name", "surname"), "", ("gdpr", "ccpa", "lgpd", "pipeda", "appi")),
    "address": (("address", "street", "postal", "zip"), "", ("gdpr", "ccpa", "lgpd", "pipeda", "appi")),
    "birth_date": (("birth", "dob"), "", ("gdpr", "ccpa", "lgpd", "pipeda", "appi")),
}
# Words in the names of columns with data that laws protect specially.
SPECIAL = {"health": ("health", "diagnosis", "medical", "disease"), "religion": ("religion", "faith"), "race": ("race", "ethnic"), "politics": ("political", "party"), "union": ("union_member",), "biometric": ("fingerprint", "biometric", "face_id"), "genetic": ("genetic", "dna"), "sexuality": ("sexual", "orientation")}
# What marks a row as deleted, opted out, or consented to.
TRUE_WORDS = ("true", "1", "yes", "y")
CONSENT_WORDS = ("true", "1", "yes", "y", "granted", "accepted", "consented", "opted_in", "opt_in")


def scan(df: DataFrame, columns: Sequence[str] | None = None, kinds: Sequence[str] | None = None) -> DataFrame:
    """``column_name, kind, n_match, n_values, confidence`` of each text column with the likeliest kind that a tenth of its values match, with a confidence of 50 at least.

    All values are counted, all columns and kinds by one aggregation. Confidence starts at 80 and gains 10 if the column's name fits, gains 5 if over 80 % match, and loses 20 if
    under 30 %.
    """
    names = pick(df, columns, "string")
    tests = [(c, k, KINDS[k]) for c in names for k in kinds or KINDS if KINDS[k][1]]
    if not tests:
        return df.sparkSession.createDataFrame([], "column_name string, kind string, n_match long, n_values long, confidence int")
    one = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(names)], *[count_if(F.col(c).rlike(p)).alias(f"m{i}") for i, (c, _, (_, p, _)) in enumerate(tests)])
    made = []
    for i, (c, k, (hints, _, _)) in enumerate(tests):
        n, m = F.col(f"n{names.index(c)}"), F.col(f"m{i}")
        share = F.coalesce(F.try_divide(m, n), F.lit(0.0))
        hint = 10 if any(h in c.lower() for h in hints) else 0
        confidence = 80 + hint + F.when(share > 0.8, 5).otherwise(0) - F.when(share < 0.3, 20).otherwise(0)
        made.append(F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), m.alias("n_match"), n.alias("n_values"), confidence.cast("int").alias("confidence"), share.alias("share"), F.lit(i).alias("i")))
    found = one.select(F.inline(F.array(*made))).where("share >= 0.1 and confidence >= 50")
    first = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("confidence"), "i"))
    return found.withColumn("first", first).where("first = 1").drop("share", "i", "first")


def found_in_text(df: DataFrame, column: str) -> DataFrame:
    """``kind, n_rows, n_found``: addresses, numbers and the like inside longer texts."""
    kinds = {
        "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
        "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
        "us_ssn": r"\b\d{3}-\d{2}-\d{4}\b",
        "credit_card": r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b",
    }
    telling = {"email": F.col(column).contains("@")}  # what a text must hold is sought first; the others need a digit
    digit = F.col(column).rlike(r"\d{3}|\d\.\d")
    counts = [F.when(telling.get(k, digit), F.regexp_count(F.col(column), F.lit(p))).otherwise(0).alias(k) for k, p in kinds.items()]
    each = df.where(F.col(column).isNotNull()).select(F.explode(F.array(F.struct(*counts))).alias("n"))  # a generator, so that the counts aren't evaluated for each use
    one = each.agg(*[count_if(F.col(f"n.{k}") > 0).alias(f"r_{k}") for k in kinds], *[F.sum(f"n.{k}").alias(f"n_{k}") for k in kinds])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"r_{k}").alias("n_rows"), F.coalesce(F.col(f"n_{k}"), F.lit(0)).alias("n_found")) for k in kinds])))


def redacted(x: Column) -> Column:
    """Letters and digits as ``*``: addresses keep @ and dots, structured numbers keep hyphens, anything else goes whole."""
    mail = x.rlike(r"^[^@\s]+@[^@\s]+\z")
    return F.when(mail, F.regexp_replace(x, r"[^@.]", "*")).when(x.rlike(r"^[\d-]+-[\d-]+\z"), F.regexp_replace(x, r"\d", "*")).otherwise(F.repeat(F.lit("*"), F.char_length(x)))


def hashed(x: Column) -> Column:
    """16 hexadecimal digits of the value's SHA-256."""
    return F.substring(F.sha2(x.cast("binary"), 256), 1, 16)


def faked(x: Column) -> Column:
    """A made-up value of the same shape, the same for equal values."""
    n = F.pmod(F.xxhash64(x), F.lit(10**10))
    text = F.lpad(n.cast("string"), 10, "0")
    mail = F.concat(F.lit("user"), F.substring(text, 1, 6), F.lit("@example.com"))
    ssn = F.concat_ws("-", F.substring(text, 1, 3), F.substring(text, 4, 2), F.substring(text, 6, 4))
    phone = F.concat_ws("-", F.substring(text, 1, 3), F.substring(text, 4, 3), F.substring(text, 7, 4))
    made = F.when(x.rlike(r"^[^@\s]+@[^@\s]+\z"), mail).when(x.rlike(r"^\d{3}-\d{2}-\d{4}\z"), ssn).when(x.rlike(r"^\+?[\d\s().-]{7,}\z"), phone).otherwise(F.concat(F.lit("value_"), text))
    return F.when(x.isNotNull(), made)


STRATEGIES = {"redact": redacted, "hash": hashed, "fake": faked}


def mask(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "redact", strict: bool = False) -> DataFrame:
    """``df`` with masked columns: the given ones, or the text columns in which `scan` finds something. Unknown columns are passed over, or raise if ``strict``."""
    if columns is None:
        columns = sorted({r["column_name"] for r in scan(df).select("column_name").collect()})
    missing = [c for c in columns if c not in df.columns]
    if missing and strict:
        raise ValueError(f"no such columns: {', '.join(missing)}")
    return df.withColumns({c: STRATEGIES[strategy](F.col(c).cast("string")) for c in columns if c in df.columns})


def _hinted(df: DataFrame, law: str) -> list[tuple[str, str]]:
    return [(f.name, k) for f in df.schema.fields for k, (hints, _, laws) in KINDS.items() if law in laws and any(h in f.name.lower() for h in hints)]


def compliance(name: str, law: str) -> Check:
    """Columns with personal data in the sense of a law: by their names, or by their values."""

    def plan(df: DataFrame) -> DataFrame:
        kinds = [k for k, v in KINDS.items() if law in v[2]]
        by_name = _hinted(df, law)
        out = literal_rows(df, name, [(c, f"{law}_{k}") for c, k in by_name], "high", ("*", "no_hint"))
        found = scan(df, kinds=[k for k in kinds if KINDS[k][1]]) if any(isinstance(f.dataType, T.StringType) for f in df.schema.fields) else None
        if found is None:
            return out
        level = F.when(F.col("confidence") >= 85, "high").otherwise("medium")
        rows = found.select(F.lit(name).alias("check_name"), "column_name", F.concat(F.lit(f"{law}_"), "kind").alias("issue"), F.col("n_match").alias("n_bad"), F.col("n_values").alias("n_rows"), F.col("confidence").cast("double").alias("actual"), level.alias("severity"))
        return out.unionByName(rows)

    return Check(name, plan)


def gdpr_compliance() -> Check:
    return compliance("gdpr_compliance", "gdpr")


def ccpa_compliance() -> Check:
    return compliance("ccpa_compliance", "ccpa")


def lgpd_compliance() -> Check:
    return compliance("lgpd_compliance", "lgpd")


def pipeda_compliance() -> Check:
    return compliance("pipeda_compliance", "pipeda")


def appi_compliance() -> Check:
    return compliance("appi_compliance", "appi")


def global_privacy(laws: Sequence[str] = ("gdpr", "ccpa", "lgpd", "pipeda", "appi")) -> Check:
    """The findings of several laws together."""
    return Check("global_privacy", lambda df: reduce(DataFrame.unionByName, [compliance("global_privacy", law).plan(df) for law in laws]))


#: Laws that plugins add: kind to (name hints, pattern).
PLUGINS: dict[str, Mapping[str, tuple[tuple[str, ...], str]]] = {
    "hipaa": {"medical_record": (("mrn", "medical_record"), r"^MRN-?\d{6,10}\z")},
    "pci_dss": {"card": (("card", "pan"), r"^\d{13,19}\z")},
    "popia": {"south_african_id": (("sa_id", "id_number"), r"^\d{13}\z")},
    "kvkk": {"tc_kimlik": (("tc", "kimlik"), r"^[1-9]\d{10}\z")},
    "pdpa": {"nric": (("nric",), r"^[STFG]\d{7}[A-Z]\z")},
    "pdpb": {"aadhaar": (("aadhaar",), r"^\d{4}\s?\d{4}\s?\d{4}\z")},
}


def plugin_based_privacy(law: str) -> Check:
    """A plugin's kinds, by the values of all text columns."""

    def plan(df: DataFrame) -> list[Measure]:
        kinds = PLUGINS[law]
        return [Measure("plugin_based_privacy", c, f"{law}_{k}", count_if(F.col(c).rlike(p)), F.count(c), limit=0.1, grade="high") for c in pick(df, None, "string") for k, (_, p) in kinds.items()]

    return Check("plugin_based_privacy", plan)


def _special(name: str) -> Check:
    return Check(name, lambda df: literal_rows(df, name, [(c, f"special_{k}") for c in df.columns for k, words in SPECIAL.items() if any(w in c.lower() for w in words)], "critical"))


def gdpr_special_category() -> Check:
    return _special("gdpr_special_category")


def ccpa_sensitive_info() -> Check:
    return _special("ccpa_sensitive_info")


def data_retention(date_column: str, retention_days: int, now: datetime | None = None) -> Check:
    clock = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    cutoff = clock - F.make_dt_interval(F.lit(retention_days))
    return Check("data_retention", lambda df: [Measure("data_retention", date_column, "retention_exceeded", count_if(F.col(date_column).cast("timestamp") < cutoff), grade="high")])


def _held(pii_columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in pii_columns])


def consent_tracking(consent_column: str, pii_columns: Sequence[str], valid: Sequence[str] = CONSENT_WORDS) -> Check:
    """Rows with personal data but no valid consent."""
    given = F.coalesce(F.lower(F.col(consent_column).cast("string")).isin(list(valid)), F.lit(False))
    return Check("consent_tracking", lambda df: [Measure("consent_tracking", consent_column, "missing_consent", count_if(_held(pii_columns) & ~given), count_if(_held(pii_columns)), grade="critical")])


def ccpa_do_not_sell(optout_column: str, sharing_columns: Sequence[str], opted_out: Sequence[str] = TRUE_WORDS) -> Check:
    out = F.lower(F.col(optout_column).cast("string")).isin(list(opted_out))
    return Check("ccpa_do_not_sell", lambda df: [Measure("ccpa_do_not_sell", optout_column, "shared_after_optout", count_if(out & _held(sharing_columns)), count_if(out), grade="critical")])


def ccpa_consumer_rights(consumer_id_column: str, deletion_request_column: str | None = None) -> Check:
    """A missing id column, and open deletion requests."""

    def plan(df: DataFrame) -> DataFrame | list[Measure]:
        if consumer_id_column not in df.columns:
            return literal_rows(df, "ccpa_consumer_rights", [(consumer_id_column, "missing_consumer_id")], "high")
        made = [Measure("ccpa_consumer_rights", consumer_id_column, "null_consumer_id", count_if(F.col(consumer_id_column).isNull()), grade="medium")]
        if deletion_request_column:
            made.append(Measure("ccpa_consumer_rights", deletion_request_column, "pending_deletion", F.count(deletion_request_column), grade="high"))
        return made

    return Check("ccpa_consumer_rights", plan)


def gdpr_data_minimization(max_null_ratio: float = 0.95, max_pii_columns: int = 10) -> Check:
    """Personal columns that are nearly empty, and too many of them."""

    def plan(df: DataFrame) -> list[Measure]:
        names = sorted({c for c, _ in _hinted(df, "gdpr")})
        made = [Measure("gdpr_data_minimization", c, "unused_personal_data", count_if(F.col(c).isNull()), limit=max_null_ratio, grade="medium") for c in names]
        return [*made, Measure("gdpr_data_minimization", "*", "too_many_personal_columns", F.max(F.lit(int(len(names) > max_pii_columns))), F.lit(1), F.max(F.lit(float(len(names)))), grade="medium")]

    return Check("gdpr_data_minimization", plan)


def gdpr_right_to_erasure(deletion_flag_column: str, pii_columns: Sequence[str], deleted: Sequence[str] = TRUE_WORDS) -> Check:
    gone = F.lower(F.col(deletion_flag_column).cast("string")).isin(list(deleted))
    return Check("gdpr_right_to_erasure", lambda df: [Measure("gdpr_right_to_erasure", deletion_flag_column, "personal_data_after_deletion", count_if(gone & _held(pii_columns)), count_if(gone), grade="critical")])


