"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared


#: Links that a file of a round's table holds at least, where there are so many.
LINKS = 20_000


def stars(e: DataFrame) -> bool:
    """Whether links (u, v) with u > v are stars: every u stands once, and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 OR low > 0 AND top > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps: a node's neighbours are led to the smallest of them, which takes about
    log(n) rounds whatever the shape, and each round is two aggregates and joins over the links. Minima are summed
    up before the shuffle; a join that a much linked node makes uneven is split by AQE. Nothing but counts comes to
    the driver. Rounds are cut by tables in the shared folder, in files of LINKS links or more; they end when all is stars.
    """
    e = shared.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    files = 1 + e.count() // LINKS  # rounds never add links
    while not stars(e):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("x")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        small = large.join(least, F.col("u") == F.col("x"))
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).distinct()
        e = shared.table(small.coalesce(files))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
