"""Search plans, result joins and the prompt column for batch inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.constants import PROMPT
from leadloom.functions.contacts import email_domain
from leadloom.functions.text import col, filled, json_string, non_empty, strip

RESULTS_TYPE = "array<struct<title:string,link:string,snippet:string>>"


def quoted_term(c: Column | str) -> Column:
    """The text in double quotes, inner quotes removed; null when nothing is left."""
    text = strip(F.replace(col(c), F.lit('"'), F.lit("")))
    return F.nullif(F.regexp_replace(text, "(?s)^(.+)$", '"$1"'), F.lit(""))


def add_search_plan(df: DataFrame, output: str = "plan") -> DataFrame:
    """Struct `company_query, person_query, params`; a null query means the search is skipped.

    A company whose site was read needs no company search; a person needs a name.
    """
    prepared = df.withColumns({
        "_company": quoted_term("company_name"),
        "_place": F.coalesce(filled("country"), filled("city")),
    })
    company_query = F.when(
        ~F.coalesce(F.col("has_scraped_data"), F.lit(False)),
        F.nullif(F.concat_ws(" ", "_company", "_place"), F.lit("")),
    )
    person_query = F.when(
        strip("name") != "",
        F.concat_ws(" ", F.lit("site:linkedin.com"), quoted_term("name"), "_company"),
    )
    params = F.map_filter(
        F.create_map(
            F.lit("gl"), F.lower(strip("search_locale")), F.lit("hl"), F.lower(strip("language"))
        ),
        lambda _, v: v != "",
    )
    return prepared.withColumn(
        output,
        F.struct(
            company_query.alias("company_query"), person_query.alias("person_query"),
            params.alias("params"),
        ),
    ).drop("_company", "_place")


def _result(title: Column, link: Column, snippet: Column) -> Column:
    return F.struct(title.alias("title"), link.alias("link"), snippet.alias("snippet"))


def stand_in_results(df: DataFrame, plan: str = "plan") -> DataFrame:
    """Repeatable search results derived from the lead, for runs without a search service."""
    company, name = non_empty("company_name"), non_empty("name")
    prepared = df.withColumns({
        "_label": F.coalesce(company, F.lit("Unknown Co")),
        "_slug": F.lower(F.coalesce(company, F.lit("example"))),
        "_place": F.coalesce(non_empty("country"), non_empty("city"), F.lit("their city")),
        "_person": F.when(F.col(f"{plan}.person_query").isNotNull(), name),
    })
    label, slug, person = F.col("_label"), F.col("_slug"), F.col("_person")
    none = F.array().cast(RESULTS_TYPE)
    about = _result(
        F.concat(label, F.lit(" | About Us")),
        F.concat(F.lit("https://www."), F.replace(slug, F.lit(" "), F.lit("")), F.lit(".example")),
        F.concat(
            label, F.lit(" is a B2B supplier based in "), F.col("_place"),
            F.lit(", serving industrial customers."),
        ),
    )
    profile = _result(
        F.concat(label, F.lit(" on LinkedIn")),
        F.concat(
            F.lit("https://www.linkedin.com/company/"), F.replace(slug, F.lit(" "), F.lit("-"))
        ),
        F.concat(F.lit("View "), label, F.lit(" on LinkedIn.")),
    )
    member = _result(
        F.concat(person, F.lit(" - "), label),
        F.concat(
            F.lit("https://www.linkedin.com/in/"),
            F.replace(F.lower(person), F.lit(" "), F.lit("-")),
        ),
        F.concat(person, F.lit(" works at "), label, F.lit(".")),
    )
    return prepared.withColumns({
        "company_results": F.when(
            F.col(f"{plan}.company_query").isNotNull(), F.array(about, profile)
        ).otherwise(none),
        "person_results": F.when(person.isNotNull(), F.array(member)).otherwise(none),
    }).drop("_label", "_slug", "_place", "_person")


def join_results(df: DataFrame, results: DataFrame) -> DataFrame:
    """Leads with their search results (`email, company_results, person_results`, unique e-mail),
    empty lists when there are none."""
    none = F.array().cast(RESULTS_TYPE)
    joined = df.join(results.select("email", "company_results", "person_results"), "email", "left")
    return joined.withColumns({
        c: F.coalesce(c, none) for c in ("company_results", "person_results")
    })


def _line(label: str, value: Column) -> Column:
    """`  label: value`, or null without a value."""
    return F.concat(F.lit(f"  {label}: "), value)


def _context_section() -> Column:
    domain = email_domain("email")
    code = non_empty("detected_country_code")

    def known(name: str, otherwise: str) -> Column:
        return F.coalesce(non_empty(name), F.lit(otherwise))

    return F.concat_ws(
        "\n",
        F.lit(PROMPT["context"]),
        _line("Contact", known("name", "Unknown")),
        F.concat(
            _line("Email", known("email", "Unknown")),
            F.coalesce(F.concat(F.lit(" (domain: "), domain, F.lit(")")), F.lit("")),
        ),
        _line("Company", known("company_name", "Unknown")),
        F.concat(
            _line("Location", F.concat_ws(
                ", ", known("city", "?"), known("state", "?"), known("country", "?")
            )),
            F.coalesce(F.concat(F.lit(" ["), code, F.lit("]")), F.lit("")),
        ),
        _line("Likely working language", non_empty("language")),
        _line("CSV-supplied website", non_empty("website_csv")),
        _line("CSV notes", filled("notes")),
    )


def _filled_template(template: str, *values: Column) -> Column:
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value, F.lit(piece)]
    return F.concat(*parts)


def _site_section(site: str) -> Column:
    def part(name: str) -> Column:
        return F.col(f"{site}.{name}")

    socials = F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(
                F.map_entries(part("social_links")),
                lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])),
            ),
            ", ",
        ),
        F.lit("}"),
    )
    found = F.concat_ws(
        "\n",
        _filled_template(PROMPT["site"], part("final_url")),
        _line("Title", non_empty(part("title"))),
        _line("Meta description", non_empty(part("description"))),
        F.concat(F.lit("  Homepage text:\n"), filled(part("text"))),
        F.concat(
            F.lit("  About page ("), F.coalesce(part("about_url"), F.lit("(about page)")),
            F.lit("):\n"), filled(part("about_text")),
        ),
        F.when(
            F.size(part("social_links")) > 0, _line("Social links found on site", socials)
        ),
    )
    failed = _filled_template(
        PROMPT["site_failed"], F.coalesce(non_empty(part("status")), F.lit("unknown")),
        F.coalesce(part("error"), F.lit("")),
    )
    return (
        F.when(F.col(site).isNull(), F.lit(PROMPT["site_absent"]))
        .when(part("status") == "ok", found)
        .otherwise(failed)
    )


def _json_results(results: str) -> Column:
    """The list as indented JSON (two spaces a level)."""
    items = F.transform(
        col(results),
        lambda r: F.concat(
            F.lit("  {\n"),
            F.array_join(
                F.array(*[
                    F.concat(F.lit(f'    "{f}": '), json_string(r[f]))
                    for f in ("title", "link", "snippet")
                ]),
                ",\n",
            ),
            F.lit("\n  }"),
        ),
    )
    return F.when(F.size(results) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit("\n]"))
    )


def _snippets_section() -> Column:
    nothing = (F.size("company_results") == 0) & (F.size("person_results") == 0)
    return F.when(nothing, F.lit(PROMPT["snippets_absent"])).otherwise(F.concat_ws(
        "\n",
        F.lit(PROMPT["snippets"]),
        F.concat(F.lit("  Company results:\n"), _json_results("company_results")),
        F.concat(F.lit("  Person results:\n"), _json_results("person_results")),
    ))


def add_prompt(
    df: DataFrame, taxonomy: list[str], site: str = "site", output: str = "prompt"
) -> DataFrame:
    """One text per lead: context, own website, search results, wanted answer."""
    gap = F.lit("\n\n")
    answer = F.lit(PROMPT["answer"].replace("<TAXONOMY>", str(list(taxonomy))))
    return df.withColumn(
        output,
        F.concat(_context_section(), gap, _site_section(site), gap, _snippets_section(), gap, answer),
    )
