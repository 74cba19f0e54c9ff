"""Uploads as people send them: quoted line breaks, odd headers, encodings, files to refuse.

Every query writes the contact rows to files of the shared folder and reads them back.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.plans.inputs import LEADS_RAW, derived
from leadloom.plans.leads import raw_leads
from leadloom.plans.registry import entries_text, query
from leadloom.plans.sql import with_ctes
from leadloom.session import shared_folder
from leadloom.sources.files import list_files, plain_file_name, read_csv_files

# Cells over several lines, some with commas, quotes and an empty line, one in three of a single line.
_ADDRESS = """
 case row_id % 3 when 0 then concat('Unit ', cast(row_id as string))
  when 1 then concat('Unit ', cast(row_id as string), chr(10), 'Block "', cast(row_id % 7 as string),
   '", East', chr(10), chr(10), 'Floor 2')
  else concat('"', chr(10), cast(row_id as string), chr(10), '"') end
"""


def _write_csv(rows: DataFrame, folder: str, **options: object) -> None:
    ordered = rows.repartitionByRange("Row Id").sortWithinPartitions("Row Id")
    ordered.write.options(header=True, escape='"', **options).csv(folder)


def _upload() -> Column:
    """The folder that a file stands in."""
    return F.regexp_extract("file_path", r"/(\w+)/[^/]*$", 1).alias("upload")


@query(with_ctes(f"leads_raw as ({LEADS_RAW})", f"""
select row_id, nullif(trim(company_name), '') as company_name, {_ADDRESS} as address,
 'Row Id=' || row_id as raw_data
from leads_raw
"""))
def ingest_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose cells and headers hold quoted line breaks, read split and by default options."""
    folder = shared_folder(spark, "multiline")
    rows = raw_leads(spark, sf_dir).select(
        F.concat("row_id", F.lit("@x.in")).alias("Email"), F.expr(_ADDRESS).alias("Address"),
        F.col("company_name").alias("Company\nName"), F.col("row_id").alias("Row Id"),
    )
    _write_csv(rows, folder)
    found, _ = read_csv_files(spark, folder)
    return found.select(
        F.split_part("email", F.lit("@"), F.lit(1)).cast("bigint").alias("row_id"), "company_name",
        "address", entries_text("raw_data").alias("raw_data"),
    )


# Headers of three uploads: a byte order mark and a repeated header, blank and clashing headers, and
# one without a known e-mail header, which an outside mapping names.
_ODD = {
    "marked": ("﻿Email", "NAME", "Work  E-Mail", "x.`y"),
    "clashing": ("file_path", "Full-Name", "e.mail", "row_seq"),
    "mapped": ("mailto:", "person in charge", "Fax No", "Cells"),
}
_ODD_MAPPING = {"mailto:": "email", "person in charge": "name", "no such header": "city"}


@query(with_ctes(f"leads_raw as ({LEADS_RAW})", """
select row_id,
 case when source_file <> 'b.csv' then 'a' || row_id || '@x.in'
  when row_id % 2 = 0 then 'b' || row_id || '@x.in' end as email,
 nullif(trim(full_name), '') as name,
 case when source_file = 'a.csv' then concat_ws('; ', 'x.`y=k' || row_id)
  when source_file = 'b.csv' then concat_ws('; ', 'file_path=a' || row_id || '@x.in',
   'row_seq=k' || row_id)
  else concat_ws('; ', 'Cells=k' || row_id) end as raw_data
from leads_raw
"""))
def ingest_odd_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "odd-headers")
    raw = raw_leads(spark, sf_dir)
    cells = [
        F.concat(F.lit("a"), "row_id", F.lit("@x.in")), F.col("full_name"),
        F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("b"), "row_id", F.lit("@x.in"))),
        F.concat(F.lit("k"), "row_id"),
    ]
    for source, (name, headers) in zip(("a.csv", "b.csv", "c.csv"), _ODD.items(), strict=True):
        shown = [c.alias(h) for c, h in zip(cells, headers, strict=True)]
        if name == "marked":  # the repeated header is left blank, so the first one counts
            shown[2] = F.lit(" ").alias(headers[2])
        _write_csv(
            raw.where(F.col("source_file") == source).select(*shown, F.col("row_id").alias("Row Id")),
            f"{folder}/{name}",
        )
    mapping = F.from_json(F.lit(json.dumps(_ODD_MAPPING)), "map<string,string>")
    external = list_files(spark, f"{folder}/mapped").select(
        plain_file_name("path").alias("source_file"), mapping.alias("mapping")
    )
    rows, _ = read_csv_files(spark, folder, external)
    others = F.map_filter("raw_data", lambda k, _: k != "Row Id")
    return rows.select(
        F.element_at("raw_data", "Row Id").cast("bigint").alias("row_id"), "email", "name",
        entries_text(others).alias("raw_data"),
    )


# How the endings of the city are written: in UTF-8, as the bytes of Windows-1252, and with a byte that
# Windows-1252 does not define.
_ENDINGS = {
    "utf8": (" Zürich “€” 日本", "UTF-8"),
    "cp1252": (" Zürich \x93\x80\x94", "ISO-8859-1"),
    "latin1": (" Zürich \x81", "ISO-8859-1"),
}


@query(with_ctes(f"leads_raw as ({LEADS_RAW})", """
select row_id, case source_file when 'a.csv' then 'utf8' when 'b.csv' then 'cp1252' else 'latin1' end
  as upload,
 coalesce(nullif(trim(city), ''), 'x') || case source_file when 'a.csv' then ' Zürich “€” 日本'
  when 'b.csv' then ' Zürich “€”' else ' Zürich ' || chr(129) end as city
from leads_raw
"""))
def ingest_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "encodings")
    raw = raw_leads(spark, sf_dir)
    town = F.coalesce(F.nullif(F.trim("city"), F.lit("")), F.lit("x"))
    for source, (name, (ending, encoding)) in zip(
        ("a.csv", "b.csv", "c.csv"), _ENDINGS.items(), strict=True
    ):
        rows = raw.where(F.col("source_file") == source).select(
            F.concat("row_id", F.lit("@x.in")).alias("Email"),
            F.concat(town, F.lit(ending)).alias("City"), F.col("row_id").alias("Row Id"),
        )
        _write_csv(rows, f"{folder}/{name}", encoding=encoding)
    rows, _ = read_csv_files(spark, folder)
    return rows.select(
        F.element_at("raw_data", "Row Id").cast("bigint").alias("row_id"), _upload(), "city"
    )


# What each nation's customers send: good files, files without e-mail, rows that are too long, a
# quote that is never closed, and kinds of files that are not taken.
_GUARD = """
select case n_nationkey % 6 when 0 then 'good' when 1 then 'nomail' when 2 then 'long'
 when 3 then 'unclosed' when 4 then 'text' else 'oldbook' end as kind,
 cast(n_nationkey as string) as nation, c_custkey
from customer join nation on c_nationkey = n_nationkey
"""


@query(f"""
select nation as upload, case kind when 'nomail' then 'no email column'
  when 'long' then 'too many cells' when 'unclosed' then 'unclosed quote'
  when 'text' then 'extension' else 'unsupported' end as reason,
 case kind when 'long' then count(*) else 1 end as rejects
from ({_GUARD}) as sent where kind <> 'good' group by nation, kind
""")
def ingest_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reject with its reason: files refused as a whole, and rows of files that are read."""
    folder = shared_folder(spark, "guard")
    sent = derived(spark, sf_dir, _GUARD, ("customer", "nation")).repartition("nation")
    mail = F.concat("c_custkey", F.lit("@x.in"))
    lines = {
        "good": ("Email,City", F.concat(mail, F.lit(",y"))),
        "nomail": ("Name,City", F.concat("c_custkey", F.lit(",y"))),
        "long": ("Email,City", F.concat(mail, F.lit(",y,z"))),
        "unclosed": ("Email,City", F.concat(mail, F.lit(',y'))),
        "text": ("Email,City", F.concat(mail, F.lit(",y"))),
        "oldbook": ("Email,City", F.concat(mail, F.lit(",y"))),
    }
    kinds = {"text": "txt", "oldbook": "xls"}
    for kind, (header, line) in lines.items():
        rows = sent.where(F.col("kind") == kind).withColumn("nation", F.concat(F.lit("n"), "nation"))
        # one file per nation: the header comes first, the line that opens a quote last
        cells = [F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("k"),
                          F.lit(header).alias("line"))]
        if kind == "unclosed":
            cells.append(F.struct(F.lit(2).alias("at"), F.lit(0).cast("long").alias("k"),
                                  F.lit('"open,y').alias("line")))
        once = rows.select("nation").distinct().select("nation", F.explode(F.array(*cells)).alias("r"))
        body = rows.select("nation", F.struct(F.lit(1).alias("at"), F.col("c_custkey").alias("k"),
                                              line.alias("line")).alias("r"))
        text = once.unionByName(body).repartition("nation").sortWithinPartitions(
            "nation", "r.at", "r.k"
        )
        # a text that is written as CSV without quoting is a file of plain lines
        text.select("nation", F.col("r.line").alias("value")).write.options(
            extension=kinds.get(kind, "csv"), quote="", sep="\x01"
        ).partitionBy("nation").csv(f"{folder}/{kind}")
    _, rejects = read_csv_files(spark, folder)
    return rejects.groupBy(
        F.regexp_extract("file_path", r"/nation=n(\d+)/[^/]*$", 1).alias("upload"), "reason"
    ).agg(F.count("*").alias("rejects"))
