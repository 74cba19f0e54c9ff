"""Country, locale and language of a lead, voted from three kinds of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.constants import WEIGHT_COUNTRY, WEIGHT_PHONE, WEIGHT_TLD
from leadloom.functions import geo
from leadloom.functions.contacts import email_tld
from leadloom.functions.text import col, non_empty, strip


def add_geo_profile(
    df: DataFrame,
    email: str = "email",
    phone: str = "phone",
    country: str = "country",
    output: str = "profile",
) -> DataFrame:
    """Add a struct `country, country_code, search_locale, language, signals, confidence`.

    Three broadcast lookups and a row-local vote: no shuffle.  With weights 0.6, 0.4 and 0.3 no two
    candidates can tie, and only phone and domain together outvote a stated country.
    """
    spark = df.sparkSession
    names = geo.country_name_dim(spark).select("name_key", F.col("code").alias("_by_name"))
    calling = geo.calling_code_dim(spark).select("calling_key", F.col("code").alias("_by_phone"))
    countries = geo.country_dim(spark).select(
        F.col("country_code").alias("_win"),
        F.col("country_name").alias("_win_name"),
        F.col("language").alias("_win_language"),
    )

    tld = F.col("_tld")
    by_country, by_phone, by_tld = F.col("_by_country"), F.col("_by_phone"), F.col("_by_tld")
    keyed = (
        df.withColumns({
            "name_key": geo.country_name_key(country),
            "calling_key": geo.calling_key(phone),
            "_tld": email_tld(email),
        })
        .join(F.broadcast(names), "name_key", "left")
        .join(F.broadcast(calling), "calling_key", "left")
        .withColumns({
            "_by_country": F.coalesce(F.col("_by_name"), geo.country_from_iso(country)),
            "_by_tld": geo.country_from_tld(tld),
        })
    )
    outvoted = (by_phone == by_tld) & (by_country.isNull() | (by_country != by_phone))
    voted = keyed.withColumn(
        "_win",
        F.when(outvoted, by_phone).otherwise(F.coalesce(by_country, by_phone, by_tld)),
    ).join(F.broadcast(countries), "_win", "left")

    win = F.col("_win")

    def weight(vote, value):
        return F.when(vote == win, F.lit(value)).otherwise(0.0)

    support = (
        weight(by_country, WEIGHT_COUNTRY) + weight(by_phone, WEIGHT_PHONE)
        + weight(by_tld, WEIGHT_TLD)
    )
    given_country = non_empty(country)
    signals = F.array_compact(F.array(
        F.when(
            given_country.isNotNull(),
            F.concat(
                F.lit("csv_country='"), strip(country), F.lit("'->"),
                F.coalesce(by_country, F.lit("unknown")),
            ),
        ),
        F.when(
            by_phone.isNotNull(),
            F.concat(F.lit("phone_prefix='"), F.substring(col(phone), 1, 6), F.lit("'->"), by_phone),
        ),
        F.when(
            by_tld.isNotNull(), F.concat(F.lit("email_tld='."), tld, F.lit("'->"), by_tld)
        ).when(
            geo.is_generic_tld(tld),
            F.concat(F.lit("email_tld='."), tld, F.lit("'->generic(ignored)")),
        ),
    ))
    profile = F.struct(
        F.col("_win_name").alias("country"),
        win.alias("country_code"),
        F.lower(win).alias("search_locale"),
        F.col("_win_language").alias("language"),
        signals.alias("signals"),
        F.round(F.least(F.lit(1.0), support), 3).alias("confidence"),
    )
    return voted.select(*[F.col(f"`{c}`") for c in df.columns], profile.alias(output))


def apply_geo_profile(df: DataFrame, profile: str = "profile") -> DataFrame:
    """Fill `country` only where it is missing; the derived codes always follow the profile."""
    return df.withColumns({
        "country": F.coalesce(non_empty("country"), F.col(f"{profile}.country")),
        "detected_country_code": F.col(f"{profile}.country_code"),
        "search_locale": F.col(f"{profile}.search_locale"),
    })


def add_language(df: DataFrame, code: str = "detected_country_code") -> DataFrame:
    """Business language of a country code, whatever its case."""
    dim = geo.country_dim(df.sparkSession).select(
        F.col("country_code").alias("_code"), F.col("language")
    )
    return (
        df.withColumn("_code", F.upper(F.col(code)))
        .join(F.broadcast(dim), "_code", "left")
        .drop("_code")
    )
