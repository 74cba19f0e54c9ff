"""Robots rules as a table, and pages tested against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import strip
from leadloom.functions.urls import url_host
from leadloom.operators.joins import lookup_join


def robots_rules(bodies: DataFrame, user_agent: str) -> DataFrame:
    """`host, rules` from `host, body`: the rules that apply to the agent, in file order.

    Lines become rows; a group starts at an agent line that does not follow another agent line.  The
    first group naming the agent applies, else the first `*` group.  A blank line right after agent
    lines ends the group before it has rules.  Windows and lists stay within one host's file.
    """
    agent = user_agent.split("/")[0].lower()
    lines = bodies.select(
        "host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("pos", "raw")
    )
    text = strip(F.regexp_replace("raw", "#.*$", ""))
    field = F.lower(strip(F.substring_index(text, ":", 1)))
    value = strip(F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    kind = (
        F.when(F.col("raw") == "", "blank")
        .when(~text.contains(":"), F.lit(None))
        .when(field == "user-agent", "agent")
        .when(field.isin("allow", "disallow"), "rule")
        .when(field.isin("crawl-delay", "request-rate"), "delay")
    )
    in_file = Window.partitionBy("host").orderBy("pos")
    groups = (
        lines.select(
            "host", "pos", kind.alias("kind"), field.alias("field"), value.alias("value")
        )
        .where(F.col("kind").isNotNull())
        .withColumn("before", F.lag("kind").over(in_file))
        .withColumn(
            "starts",
            ((F.col("kind") == "agent") & ~F.coalesce(F.col("before") == "agent", F.lit(False)))
            .cast("int"),
        )
        .withColumn("block", F.sum("starts").over(in_file))
        .withColumn(
            "open",
            F.last(F.when(F.col("kind").isin("agent", "blank"), F.col("kind")), ignorenulls=True)
            .over(in_file) == "agent",
        )
    )
    name = F.lower("value")
    blocks = groups.groupBy("host", "block").agg(
        F.bool_or((F.col("kind") == "agent") & (F.col("value") == "*")).alias("for_all"),
        F.bool_or(
            (F.col("kind") == "agent") & (F.col("value") != "*")
            & F.lit(agent).contains(name)
        ).alias("for_us"),
        F.bool_or((F.col("kind") != "agent") & (F.col("kind") != "blank") & F.col("open"))
        .alias("complete"),
        F.array_sort(F.collect_list(F.when(
            (F.col("kind") == "rule") & F.col("open"),
            F.struct(
                "pos", F.col("value").alias("prefix"),
                ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
            ),
        ))).alias("rules"),
    )
    rank = F.when(F.col("for_us") & ~F.col("for_all"), 0).when(F.col("for_all"), 1)
    return (
        blocks.where(F.col("complete"))
        .withColumn("rank", rank)
        .where(F.col("rank").isNotNull())
        .groupBy("host")
        .agg(F.min_by("rules", F.struct("rank", "block")).alias("rules"))
    )


def with_robots_verdict(
    pages: DataFrame, rules: DataFrame, url: str = "url", spread_by: list[str] | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add `robots_allowed`: the first rule whose prefix starts the path decides; no rule allows.

    A host's rules stay one array, so no page x rule pairs are produced.
    """
    keyed = pages.withColumn("host", F.lower(url_host(url)))
    joined = lookup_join(keyed, rules, "host", spread_by=spread_by or [url], counts=counts)
    # path and query, a slash for an empty path
    rest = F.regexp_extract(F.col(url), r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    target = F.regexp_replace(F.regexp_replace(rest, r"\?$", ""), "^(?!/)", "/")
    hit = F.get(F.filter("rules", lambda r: target.startswith(r["prefix"])), F.lit(0))
    return joined.withColumn(
        "robots_allowed", F.coalesce(hit["allow"], F.lit(True))
    ).drop("rules")
