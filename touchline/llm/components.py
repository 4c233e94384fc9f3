"""Connected components of a link table, without collecting links or groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.sources.store import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u's neighbourhood."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u itself, is linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one other at most, which hangs on none."""
    end = lambda name, hangs: F.struct(F.col(name).alias("node"), F.lit(hangs).alias("hangs"))
    ends = links.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("e")).select("e.*").groupBy("node")
    seen = ends.agg(F.sum("hangs").alias("times"), F.min("hangs").alias("least"))
    return seen.agg(F.count_if(F.expr("times > 1 OR times > 0 AND least = 0"))).first()[0] == 0


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): each linked node with the smallest node it can reach.

    `links` has two long columns u and v with u != v and no nulls. Alternates the
    two star steps until every node hangs on its smallest node; each step is two
    joins on a key and is written to the shared folder, so a lost executor costs
    no replay. Links that are stars already are left as they are. Nodes without a
    link do not appear; no links give no rows.
    """
    links = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _all_stars(links):
        links = materialize(_small_star(_large_star(links)))
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
