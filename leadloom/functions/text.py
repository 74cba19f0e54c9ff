"""Text expressions shared by the other modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character `str.strip` removes; `trim` alone would only take plain spaces.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted_name(header: str) -> Column:
    """Column reference for any header text, dots and backticks included."""
    return F.col("`" + header.replace("`", "``") + "`")


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def filled(c: Column | str) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def non_empty(c: Column | str) -> Column:
    """The text as it is, null when empty."""
    return F.nullif(col(c), F.lit(""))


def any_match(c: Column, patterns) -> Column:
    """True when one of the patterns is found, whatever the case."""
    return c.rlike("(?i)" + "|".join(patterns))


def json_string(c: Column) -> Column:
    """A JSON string literal of the text, escaped the JSON way."""
    wrapped = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(
        F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    )


def percent(part: Column, total: Column) -> Column:
    """Share in percent with one decimal; 0 when there is nothing to count."""
    return F.round(100.0 * part / F.greatest(total, F.lit(1)), 1)
