"""Connected components of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.tables import materialise


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``links`` (a, b: long).

    Alternates two steps until every node points at a root that points nowhere.  In the first, a node's
    larger neighbours are joined to its smallest neighbour, in the second its smaller ones and itself.
    A node's neighbours are never gathered: each step is a minimum by node and a join, and each
    result is a table, so lineage stays short.  The number of rounds grows with the logarithm of the longest chain.
    """
    edges = materialise(_down(links.filter("a <> b")), "links")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = _down(large.filter("a <> b"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        edges = materialise(_down(small.union(low.select("u", "m"))), "links")
        # done when the targets are roots and no node has two of them
        open_ends = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select(F.lit(1).alias("x"))
        twice = edges.groupBy("u").count().filter("count > 1").select(F.lit(1).alias("x"))
        if not open_ends.union(twice).limit(1).count():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct() if "a" in links.columns else links.toDF("u", "v").distinct()
