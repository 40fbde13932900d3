"""Connected components of links, by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import fresh_folder
from .ship import session_of


def _least(edges: DataFrame) -> DataFrame:
    """(u, least): the smallest neighbour.  Grouped by more than ``u``, so that a join on ``u`` has an exchange
    on both sides and a node with many links can be split."""
    return edges.groupBy("u", F.hash("u").alias("_")).agg(F.min("v").alias("least")).select(F.col("u").alias("_u"), "least")


def _with_least(edges: DataFrame) -> DataFrame:
    return edges.join(_least(edges), F.col("u") == F.col("_u")).select("u", "v", "least")


#: Links in a file, about.
LINKS = 500_000


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has either one link, to a smaller node, or only links from larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    both = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return both.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, class) of every node of ``links(a, b)``; the class is the smallest node of the component."""
    spark = session_of(links)
    folder = fresh_folder(spark, "components")
    parts = max(8, -(-links.count() // LINKS))

    def settled(edges: DataFrame, name: str) -> DataFrame:
        edges.where("u <> v").distinct().coalesce(parts).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    step = 0
    while not _are_stars(edges):
        step += 1
        both = _with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = settled(both.where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v")), f"large-{step}")
        small = _with_least(large)
        small = small.select("u", F.col("least").alias("v")).unionByName(small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")))
        edges = settled(small, f"small-{step}")
    # Only stars are left: every node has one link, to the smallest of its component.
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("class"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class"))).distinct()
