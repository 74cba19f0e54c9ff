"""Country evidence: expressions, and the small lookup tables they are joined with.

The lookup tables are literal relations of fixed size (63 countries, about 90 names), so Spark
broadcasts them; no row of a data table is ever matched through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.constants import (
    CCTLD_EXCEPTIONS,
    COUNTRIES,
    COUNTRY_ALIASES,
    FOLDED_FROM,
    FOLDED_TO,
    GENERIC_TLDS,
    SHARED_CALLING_CODES,
)
from leadloom.functions.text import col, strip

COUNTRY_CODES = [code for code, _, _, _ in COUNTRIES]


def sql_values(rows) -> str:
    """Rows as the body of a SQL VALUES list."""
    def literal(value):
        return "'" + str(value).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)


def country_name_rows() -> list[tuple[str, str]]:
    """(lower-case name, code); another spelling beats an official name."""
    names = {name.lower(): code for code, name, _, _ in COUNTRIES}
    return sorted({**names, **COUNTRY_ALIASES}.items())


def calling_code_rows() -> list[tuple[str, str]]:
    """(calling code, country code), one row per calling code."""
    codes = {calling: code for code, _, calling, _ in COUNTRIES}
    return sorted({**codes, **SHARED_CALLING_CODES}.items())


def country_dim(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "select * from values " + sql_values(COUNTRIES)
        + " as t(country_code, country_name, calling_code, language)"
    )


def country_name_dim(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "select * from values " + sql_values(country_name_rows()) + " as t(name_key, code)"
    )


def calling_code_dim(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "select * from values " + sql_values(calling_code_rows()) + " as t(calling_key, code)"
    )


def fold_diacritics(c: Column | str) -> Column:
    return F.translate(F.replace(col(c), F.lit("ß"), F.lit("ss")), FOLDED_FROM, FOLDED_TO)


def country_name_key(c: Column | str) -> Column:
    """Join key into `country_name_dim`."""
    return fold_diacritics(F.lower(strip(c)))


def _one_of(c: Column, codes: list[str]) -> Column:
    """The text when it is one of the codes, else null."""
    return F.nullif(F.regexp_extract(c, f"^(?:{'|'.join(codes)})$", 0), F.lit(""))


def country_from_iso(c: Column | str) -> Column:
    """The text itself when it is a known two-letter code."""
    return _one_of(F.upper(strip(c)), COUNTRY_CODES)


def calling_key(phone: Column | str) -> Column:
    """Join key into `calling_code_dim`.

    Calling codes are prefix-free: the first one or two digits decide how long the code is, so one
    equality join replaces a longest-prefix search.  Only `+` and `00` numbers have a calling code.
    """
    number = F.regexp_replace(strip(phone), r"(?!^\+)\D+", "")
    short = "|".join(c for c, _ in calling_code_rows() if len(c) < 3)
    return F.regexp_extract(number, rf"^(?:\+|00)({short}|\d{{3}})", 1)


def country_from_tld(tld: Column) -> Column:
    """Country of an e-mail's last domain label; generic labels say nothing."""
    telling = [code for code in COUNTRY_CODES if code.lower() not in GENERIC_TLDS]
    country = _one_of(F.upper(tld), telling)
    for label, code in CCTLD_EXCEPTIONS.items():
        country = F.when(tld == label, F.lit(code)).otherwise(country)
    return country


def is_generic_tld(tld: Column) -> Column:
    return tld.rlike(f"^(?:{'|'.join(GENERIC_TLDS)})$")
