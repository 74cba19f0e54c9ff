"""Cleaning of contact fields: e-mail, phone, website, name; completeness score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.constants import (
    DOMAIN_LABEL_MAX_CHARS,
    EMAIL_LOCAL_MAX_CHARS,
    EMAIL_MAX_CHARS,
    EMAIL_PATTERN,
    IDEOGRAPHIC_DOTS,
    INTERNATIONAL_DOMAIN,
    INTERNATIONAL_LOCAL,
    LATE_LETTERS,
    QUALITY_WEIGHTS,
    SPECIAL_USE_DOMAINS,
)
from leadloom.functions.text import col, filled, strip

# One pattern with the length limits as look-aheads, so the cell is read by a single expression and
# junk fails before the syntax part starts.
_EMAIL = (
    rf"^(?=.{{3,{EMAIL_MAX_CHARS}}}$)(?=[^@]{{1,{EMAIL_LOCAL_MAX_CHARS}}}@)"
    rf"(?!.*@.*[a-z0-9-]{{{DOMAIN_LABEL_MAX_CHARS + 1}}})"
    # labels with hyphens in their third and fourth place are reserved
    r"(?!.*@(?:.*[.])?[a-z0-9-]{2}--)"
    rf"(?!.*[.](?:{'|'.join(SPECIAL_USE_DOMAINS)})$)"
    rf"{EMAIL_PATTERN}$"
)


# The same for the ASCII form of an international domain, behind a local part that is checked apart.
_ASCII_DOMAIN = (
    rf"^x@(?=.{{1,{EMAIL_MAX_CHARS}}}$)(?!.*[a-z0-9-]{{{DOMAIN_LABEL_MAX_CHARS + 1}}})"
    r"(?!(?:.*[.])?(?!xn)[a-z0-9-]{2}--)(?!(?:.*[.])?xn--(?:[.]|$))"
    rf"(?!.*[.](?:{'|'.join(SPECIAL_USE_DOMAINS)})$)"
    rf"{EMAIL_PATTERN.split('@')[1]}$"
)


def normalise_email(c: Column | str, stripped: bool = False) -> Column:
    """Stripped lower-case address, or null when it is not a deliverable-looking address.

    `stripped` tells that the cell has been stripped before, here and below.
    """
    text = F.lower(col(c) if stripped else strip(c))
    international = (F.length(text) < F.octet_length(text)) | text.contains("@xn--") | (
        text.contains(".xn--")
    )
    return F.when(international, international_email(text)).otherwise(
        F.nullif(F.regexp_extract(text, _EMAIL, 0), F.lit(""))
    )


def international_email(text: Column) -> Column:
    """The usual form of a lower-case address with other than ASCII letters, or null: the part before
    the `@` composed, domain labels in their own letters, also if they come as `xn--`.

    The JVM's own functions map and check domains; they know two letters less than the newer rules
    (ß and final sigma), so a domain with one of these keeps it, and its `xn--` form stays as it is.
    """
    parts = r"(?s)^(.*)@([^@]*)$"
    local = _composed(F.regexp_extract(text, parts, 1))
    domain = _composed(F.regexp_replace(F.regexp_extract(text, parts, 2), IDEOGRAPHIC_DOTS, "."))
    # 1: letters younger than the function's tables are let through
    ascii_form = F.lower(F.try_reflect(
        F.lit("java.net.IDN"), F.lit("toASCII"), domain, F.lit(1)
    ))
    own = F.try_reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), ascii_form, F.lit(1))
    shown = F.when(domain.rlike(LATE_LETTERS), domain).otherwise(own)
    address = F.concat(local, F.lit("@"), shown)
    valid = (
        local.rlike(INTERNATIONAL_LOCAL)
        & (F.length(local) <= EMAIL_LOCAL_MAX_CHARS)
        & shown.rlike(INTERNATIONAL_DOMAIN)
        & F.concat(F.lit("x@"), ascii_form).rlike(_ASCII_DOMAIN)
        & (F.octet_length(address) <= EMAIL_MAX_CHARS)
        & (F.length(local) + F.length(ascii_form) < EMAIL_MAX_CHARS)
    )
    return F.when(valid, address)


def _composed(text: Column) -> Column:
    """Letters and their marks as one character where there is one."""
    return F.try_reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )


def normalise_phone(c: Column | str, default_country_code: str = "91") -> Column:
    """International form `+digits`; a bare ten-digit number gets the default country code."""
    digits = F.regexp_replace(col(c), r"\D+", "")
    national = F.regexp_replace(digits, "^00?", "")
    number = F.regexp_replace(national, r"^(\d{10})$", default_country_code + "$1")
    return F.nullif(
        F.regexp_extract(F.concat(F.lit("+"), number), r"^\+\d{7,15}$", 0), F.lit("")
    )


def clean_website(c: Column | str, stripped: bool = False) -> Column:
    """Stripped text without one trailing slash; null when blank."""
    return F.regexp_replace(col(c) if stripped else filled(c), "(?s)(?<=.)/$", "")


def full_name(name: Column | str, first: Column | str, last: Column | str) -> Column:
    """The given full name, else first and last name joined, else whichever is there."""
    return F.coalesce(
        filled(name), F.nullif(F.concat_ws(" ", filled(first), filled(last)), F.lit(""))
    )


def quality_score(stripped: bool = False) -> Column:
    """Weighted share of filled key fields, three decimals."""
    score = F.lit(0.0)
    for name, weight in QUALITY_WEIGHTS.items():
        there = F.col(name).isNotNull() if stripped else strip(name) != ""
        score = score + F.when(there, F.lit(weight)).otherwise(0.0)
    return F.round(score, 3)


def email_domain(c: Column | str) -> Column:
    """Lower-case text after the last @, null without one."""
    return F.nullif(F.regexp_extract(F.lower(col(c)), r"@\s*([^@]*?)\s*$", 1), F.lit(""))


def email_tld(c: Column | str) -> Column:
    """Last label of the e-mail domain, null when the domain has no dot."""
    return F.nullif(F.regexp_extract(F.lower(col(c)), r"@[^@]*[.]([^.@]*?)\s*$", 1), F.lit(""))
