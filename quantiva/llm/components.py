"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest neighbour (or itself)."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def _is_forest_of_stars(e: DataFrame) -> bool:
    """Every node has one link, and none leads to a node that has a link of its own."""
    several = e.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
    return several.isEmpty() and e.join(e.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of a link the smallest node that it reaches; roots stand for themselves.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until all links lead to roots; every
    round is written to the shared folder.  Minima are aggregated before they are shuffled and no
    node's neighbours are ever gathered, so a node may have any number of them.
    """
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), "links")
    while not edges.isEmpty():
        edges = stored(_small_star(_large_star(edges)).distinct(), "links")
        if _is_forest_of_stars(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
