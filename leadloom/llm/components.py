"""Connected components of a link table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import stored


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node it knows."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the least of them."""
    least = _least(links)
    handed = links.join(least, "u").where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """`node`, `root`: the least node reachable, for every node of `links` (u, v; any order, repeats
    and loops allowed; a link with a null end is none).

    Large-star and small-star rounds: each is a map-side combined minimum and a join that adaptive
    execution splits when a node has many links.  Every round is written, so a lost executor costs
    one round.  The rounds grow with the logarithm of the longest path, and none emits more links
    than it reads.
    """
    larger, smaller = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = stored(
        links.where("u <> v").select(larger, smaller).distinct(), "links"
    )
    digest = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                                               F.lit(0)))
    before, state = None, now.agg(digest).first()
    while state != before:
        now = stored(_small_star(_large_star(now)), "links")
        before, state = state, now.agg(digest).first()
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
