"""Model answers to table columns: coercion, evidence priority, evidence record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.constants import COMPANY_SIZES, DESCRIPTION_FROM_TEXT_CHARS, RELEVANCE_KEYS
from leadloom.functions.text import col, non_empty

ANSWER_FIELDS = (
    "company_website", "company_description", "industry", "industry_confidence", "sub_category",
    "company_size", "person_linkedin", "company_linkedin", *RELEVANCE_KEYS,
)
EXTRACTED_FIELDS = (
    "industry", "industry_confidence", "sub_category", "company_size", "relevance_score",
    "company_website", "company_linkedin", "person_linkedin", "company_description",
)


def _as_double(text: Column) -> Column:
    """Text that is a number; a cast alone would also take type letters, as in `0.5d`."""
    plain = text.rlike(r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$|^\s*[+-]?(nan|inf(inity)?)\s*$")
    return F.when(plain, text.try_cast("double"))


def _number(text: Column) -> Column:
    """A number between 0 and 1 out of any text; 0 when it is none."""
    value = (
        F.when(text == "true", F.lit(1.0))
        .when(text == "false", F.lit(0.0))
        .otherwise(_as_double(text))
    )
    return F.when(value.isNull(), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    )


def _says_something(text: Column) -> Column:
    """The text unless it stands for nothing: null, blank, false, zero, an empty list or object."""
    nothing = text.isin("", "false", "[]", "{}") | (
        F.coalesce(_as_double(text), F.lit(1.0)) == 0
    )
    return F.when(~nothing, text)


def add_coerced_answer(
    df: DataFrame, taxonomy: list[str], answer: str = "answer", output: str = "extracted"
) -> DataFrame:
    """Add a struct of well-typed fields out of a JSON answer that may be off schema or no JSON at
    all.  The text is parsed once, into a column of its own."""
    schema = ", ".join(f"{f} string" for f in ANSWER_FIELDS)
    first, second = (F.col(f"_data.{key}") for key in RELEVANCE_KEYS)

    def text(name: str) -> Column:
        return non_empty(F.col(f"_data.{name}")).alias(name)

    def member(name: str, allowed, default: str) -> Column:
        value = F.col(f"_data.{name}")
        return F.when(value.isin(*allowed), value).otherwise(default).alias(name)

    return (
        df.withColumn("_data", F.from_json(answer, schema))
        .withColumn("_relevance", F.coalesce(_says_something(first), second))
        .withColumn(output, F.struct(
            text("company_website"),
            text("company_description"),
            member("industry", taxonomy, "Unknown"),
            _number(F.col("_data.industry_confidence")).alias("industry_confidence"),
            text("sub_category"),
            member("company_size", COMPANY_SIZES, "unknown"),
            text("person_linkedin"),
            text("company_linkedin"),
            _number(F.col("_relevance")).alias("relevance_score"),
        ))
        .drop("_data", "_relevance")
    )


def is_answer(answer: Column | str) -> Column:
    """True when the text is a JSON object; anything else is answered by the stand-in."""
    kind = F.schema_of_variant(F.try_parse_json(col(answer)))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def _first_link(results: str, condition) -> Column:
    return F.get(F.filter(results, lambda r: condition(F.coalesce(r["link"], F.lit("")))), F.lit(0))[
        "link"
    ]


def evidence(site: str = "site", whole: bool = True) -> dict[str, Column]:
    """Website, description and profile links by priority: own site before search results.  A site
    record that is not `whole` has the start of its text only."""
    ok = F.coalesce(F.col(f"{site}.status") == "ok", F.lit(False))

    def own(name: str) -> Column:
        return F.when(ok, non_empty(F.col(f"{site}.{name}")))

    text_start = own("text_start") if not whole else F.when(
        ok, non_empty(F.substring(F.col(f"{site}.text"), 1, DESCRIPTION_FROM_TEXT_CHARS))
    )
    return {
        "company_website": F.coalesce(
            own("final_url"), _first_link("company_results", lambda x: ~x.contains("linkedin"))
        ),
        "company_description": F.coalesce(
            own("description"), text_start, F.get("company_results", F.lit(0))["snippet"]
        ),
        "company_linkedin": F.coalesce(
            F.when(ok, non_empty(F.element_at(F.col(f"{site}.social_links"), "linkedin"))),
            _first_link("company_results", lambda x: x.contains("linkedin.com/company")),
        ),
        "person_linkedin": _first_link(
            "person_results", lambda x: x.contains("linkedin.com/in")
        ),
    }


def _fraction(seed: Column, start: int) -> Column:
    """A fixed number in [0, 1) drawn from the seed's digest."""
    digits = F.conv(F.substring(F.md5(seed), start, 7), 16, 10).cast("double")
    return digits / float(16**7)


def _pick(seed: Column, start: int, values) -> Column:
    index = F.floor(_fraction(seed, start) * len(values)).cast("int")
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def add_stand_in_extraction(
    df: DataFrame, taxonomy: list[str], site: str = "site", output: str = "extracted"
) -> DataFrame:
    """Repeatable extraction for runs without a model: evidence by priority, labels and scores
    drawn from a digest of company and website, higher confidence when the own site was read."""
    picked = evidence(site, "text" in df.schema[site].dataType.fieldNames())
    ok = F.coalesce(F.col(f"{site}.status") == "ok", F.lit(False))
    seed = F.concat_ws(
        "|", F.coalesce(non_empty("company_name"), F.lit("x")), picked["company_website"]
    )
    low = F.when(ok, 0.7).otherwise(0.55)
    high = F.when(ok, 0.95).otherwise(0.85)
    labels = [label for label in taxonomy if label != "Unknown"]
    return df.withColumn(output, F.struct(
        picked["company_website"].alias("company_website"),
        picked["company_description"].alias("company_description"),
        _pick(seed, 1, labels).alias("industry"),
        F.round(low + (high - low) * _fraction(seed, 8), 2).alias("industry_confidence"),
        F.lit(None).cast("string").alias("sub_category"),
        _pick(seed, 15, COMPANY_SIZES).alias("company_size"),
        picked["person_linkedin"].alias("person_linkedin"),
        picked["company_linkedin"].alias("company_linkedin"),
        F.round(0.3 + 0.65 * _fraction(seed, 22), 2).alias("relevance_score"),
    ))


def add_extraction(
    df: DataFrame, taxonomy: list[str], answer: str = "answer", site: str = "site",
    output: str = "extracted",
) -> DataFrame:
    """The coerced answer, or the stand-in where the answer is missing or no JSON object."""
    both = add_coerced_answer(
        add_stand_in_extraction(df, taxonomy, site, "_stand_in"), taxonomy, answer, "_coerced"
    )
    return both.withColumn(
        output, F.when(is_answer(answer), F.col("_coerced")).otherwise(F.col("_stand_in"))
    ).drop("_coerced", "_stand_in")


def evidence_record(parts: dict[str, Column], extracted: str = "extracted") -> Column:
    """JSON text of everything an extraction was based on.

    A part that is null is left out; nulls inside a part are kept.
    """
    def entry(name: str, value: Column) -> Column:
        text = F.to_json(value, {"ignoreNullFields": "false"})
        return F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), text))

    summary = F.struct(*[F.col(f"{extracted}.{f}").alias(f) for f in EXTRACTED_FIELDS])
    entries = [entry(name, value) for name, value in parts.items()]
    entries.append(entry("extracted_fields", summary))
    return F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}"))


def enrichment_columns(
    df: DataFrame, record: Column, as_of: Column, name: str = "enrichment_raw"
) -> DataFrame:
    """`email` and the columns an extraction writes to the lead table, `record` under `name`."""
    return df.select(
        "email",
        *[F.col(f"extracted.{f}").alias(f) for f in EXTRACTED_FIELDS],
        record.alias(name),
        as_of.alias("enriched_at"),
    )
