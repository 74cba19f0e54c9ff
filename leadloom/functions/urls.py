"""URL expressions.  `parse_url` raises on odd hosts, so the parts are cut out by pattern.

Each function names its argument once, so that nested calls stay small expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.text import col, strip

_PARTS = r"^([^:/?#]+)://([^/?#]*)([^?#]*)"

# scheme and host, path up to its parameters and closing slashes, query; anything without a host
# matches the second branch and leaves nothing.
_CANONICAL = (
    r"(?s)^(?:([^:/?#]+://[^/?#]+)([^?#]*?)/*(?:;[^/?#]*)?(\?[^#]+)?\??(?:#.*)?|.*)$"
)


def url_scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(c), _PARTS, 1))


def url_host(c: Column | str) -> Column:
    return F.regexp_extract(col(c), _PARTS, 2)


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(col(c), _PARTS, 3)


def canonical_url(c: Column | str) -> Column:
    """Scheme added when missing, slashes at the end of the path, fragment and path parameters
    dropped; null when there is no host."""
    text = F.regexp_replace(strip(c), r"^(?!(?i)https?://)(?=.)", "https://")
    text = F.regexp_replace(text, "^(?i)http(?=s?://)", "http")
    text = F.regexp_replace(text, "^http(?i)s://", "https://")
    return F.nullif(F.regexp_replace(text, _CANONICAL, "$1$2$3"), F.lit(""))


def link_base(url: Column | str) -> Column:
    """The parts of a page address that its links are resolved against."""
    return F.struct(
        col(url).alias("url"),
        url_scheme(url).alias("scheme"),
        F.regexp_extract(col(url), "^[^:/?#]+://[^/?#]*", 0).alias("origin"),
        F.regexp_extract(col(url), "^[^?#]*", 0).alias("page"),
        F.regexp_replace(
            F.regexp_extract(col(url), "^([^:/?#]+://[^/?#]*)([^?#]*/)?", 0), "(?<!/)$", "/"
        ).alias("folder"),
        F.regexp_extract(col(url), "^[^#]*", 0).alias("document"),
    )


def absolute_url(base: Column, href: Column) -> Column:
    """A link target seen from its page (`base` from `link_base`), for the usual forms; dot segments
    are left alone."""
    return (
        F.when(href == "", base["url"])
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(base["scheme"], F.lit(":"), href))
        .when(href.startswith("/"), F.concat(base["origin"], href))
        .when(href.startswith("?"), F.concat(base["page"], href))
        .when(href.startswith("#"), F.concat(base["document"], href))
        .otherwise(F.concat(base["folder"], href))
    )
