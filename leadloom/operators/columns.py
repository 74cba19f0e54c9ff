"""From any set of headers to the canonical contact columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.constants import CANONICAL_FIELDS, HEADER_FIELDS, PROMPT, SAMPLE_CELL_CHARS
from leadloom.functions.geo import sql_values
from leadloom.functions.text import col, filled, quoted_name, strip


def header_key(c: Column | str) -> Column:
    """Lower-case letters and digits of a header."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "")


def header_dim(spark: SparkSession) -> DataFrame:
    """Known header keys and their canonical field (a fixed list of about 80 rows)."""
    return spark.sql(
        "select * from values " + sql_values(HEADER_FIELDS.items()) + " as t(header_key, field)"
    )


def map_headers(headers: list[str]) -> dict[str, str]:
    """{header: canonical field} for the headers that are known, in header order."""
    keys = {h: re.sub("[^a-z0-9]+", "", h.lower()) for h in headers}
    return {h: HEADER_FIELDS[k] for h, k in keys.items() if k in HEADER_FIELDS}


def accept_external_mapping(answer: object, headers: list[str]) -> dict[str, str]:
    """The usable part of a mapping proposed from outside: real headers, canonical fields."""
    if not isinstance(answer, dict):
        return {}
    return {
        header: field
        for header, field in answer.items()
        if header in set(headers) and isinstance(field, str) and field in CANONICAL_FIELDS
    }


def plan_mapping(headers: list[str], external: object = None) -> dict[str, str]:
    """Known headers; when no e-mail column is among them, the external mapping on top."""
    mapping = map_headers(headers)
    if "email" not in mapping.values():
        mapping = {**mapping, **accept_external_mapping(external, headers)}
    if "email" not in mapping.values():
        raise ValueError(f"no email column among headers {headers[:10]}")
    return mapping


def _name_part(header: str) -> str | None:
    part = header.lower().replace(" ", "").replace("_", "")
    return part if part in ("firstname", "lastname") else None


def resolve_columns(
    df: DataFrame, mapping: dict[str, str], keep: list[str] | None = None
) -> DataFrame:
    """One `select` to the canonical columns plus `raw_data` (filled cells of unmapped headers).

    When several headers mean one field, the last filled one wins.  `keep` names columns that are
    passed on as they are, such as file position columns.
    """
    keep = keep or []
    sources: dict[str, list[str]] = {}
    for header, field in mapping.items():
        sources.setdefault(_name_part(header) or field, []).append(header)

    def resolved(field: str) -> Column:
        cells = [filled(quoted_name(h)) for h in reversed(sources.get(field, []))]
        return F.coalesce(*cells) if cells else F.lit(None).cast("string")

    fields = {field: resolved(field) for field in CANONICAL_FIELDS}
    fields["name"] = F.coalesce(
        fields["name"],
        F.nullif(F.concat_ws(" ", resolved("firstname"), resolved("lastname")), F.lit("")),
    )
    others = [c for c in df.columns if c not in mapping and c not in keep]
    if others:
        raw_data = F.map_filter(
            F.map_from_arrays(
                F.array(*[F.lit(c) for c in others]),
                F.array(*[strip(quoted_name(c)) for c in others]),
            ),
            lambda _, v: v != "",
        )
    else:
        raw_data = F.expr("cast(map() as map<string,string>)")
    return df.select(
        *[quoted_name(c) for c in keep],
        *[column.alias(field) for field, column in fields.items()],
        raw_data.alias("raw_data"),
    )


_PARTS = ("firstname", "lastname")

# What the cells of a file mean: header names, places per field (last header first), other places.
PLAN_TYPE = (
    "struct<names:array<string>,places:struct<"
    + ",".join(f"{field}:array<int>" for field in (*CANONICAL_FIELDS, *_PARTS))
    + ">,others:array<int>>"
)


def field_places(names: list[str], mapping: dict[str, str]) -> dict[str, list[int]]:
    """Places of the headers that mean each field, the last one first."""
    places: dict[str, list[int]] = {field: [] for field in (*CANONICAL_FIELDS, *_PARTS)}
    for place, name in reversed(list(enumerate(names))):
        if name in mapping:
            places[_name_part(name) or mapping[name]].append(place)
    return places


def resolve_cells(df: DataFrame, keep: list[str]) -> DataFrame:
    """`resolve_columns` for rows of many files at once: `cells` by place, `plan` of the row's file
    (`PLAN_TYPE`).  A cell is looked up by the places of its field, usually a single one."""

    def resolved(field: str) -> Column:
        cells = F.transform(f"plan.places.{field}", lambda i: filled(F.get("cells", i)))
        return F.get(F.filter(cells, lambda c: c.isNotNull()), F.lit(0))

    fields = {field: resolved(field) for field in CANONICAL_FIELDS}
    parts = F.concat_ws(" ", *[resolved(part) for part in _PARTS])
    fields["name"] = F.coalesce(fields["name"], F.nullif(parts, F.lit("")))
    others = F.filter("plan.others", lambda i: filled(F.get("cells", i)).isNotNull())
    raw_data = F.map_from_entries(
        F.transform(
            others, lambda i: F.struct(F.get("plan.names", i), strip(F.get("cells", i)))
        )
    )
    return df.select(
        *keep,
        *[column.alias(field) for field, column in fields.items()],
        raw_data.alias("raw_data"),
    )


def sample_rows(
    df: DataFrame, headers: list[str], order: list[str], group: list[str] | None = None,
    rows: int = 3,
) -> DataFrame:
    """Up to `rows` non-empty rows out of the first `3 * rows`, blank cells dropped, cells cut.

    Both limits are the feature.  With `group` the sample is taken per group (one per file); Spark
    keeps only the first rows of a group in each task before it shuffles.
    """
    cells = F.map_filter(
        F.map_from_arrays(
            F.array(*[F.lit(h) for h in headers]),
            F.array(*[F.substring(strip(quoted_name(h)), 1, SAMPLE_CELL_CHARS) for h in headers]),
        ),
        lambda _, v: v != "",
    )
    group = group or []
    if not group:
        first = df.orderBy(*order).limit(3 * rows)
        return first.select(*order, cells.alias("cells")).where(F.size("cells") > 0).orderBy(
            *order
        ).limit(rows)
    window = Window.partitionBy(*group).orderBy(*order)
    keys = list(dict.fromkeys(group + order))
    return (
        df.withColumn("_n", F.row_number().over(window))
        .where(F.col("_n") <= 3 * rows)
        .select(*keys, cells.alias("cells"))
        .where(F.size("cells") > 0)
        .withColumn("_n", F.row_number().over(window))
        .where(F.col("_n") <= rows)
        .drop("_n")
    )


def header_question(headers: list[str], samples: list[dict[str, str]]) -> str:
    """Text that asks an outside service to map unknown headers."""
    return (
        PROMPT["headers"]
        .replace("<HEADERS>", json.dumps(headers, ensure_ascii=False))
        .replace("<ROWS>", json.dumps(samples[:5], ensure_ascii=False, indent=2))
        .replace("<FIELDS>", ", ".join(CANONICAL_FIELDS))
    )
