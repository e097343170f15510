"""Connected components of a graph given as links, in rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stmtlog.plans.stage import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of ``links`` (a, b) with the smallest node it can reach, itself included.

    Large-star and small-star rounds: each node's larger neighbours are hung on its smallest neighbour, then
    the node and its smaller neighbours on the smallest of them.  A round is two aggregations and joins of
    written tables, so a lost executor costs no earlier round, and a node with many neighbours is split by
    adaptive execution.  It ends when a round
    changes nothing.  Self links and null ends are ignored; no links give no rows.
    """
    links = links.select("a", "b").filter("a <> b")
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.distinct(), "links")
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        links = stage(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        digest = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if digest == seen:
            break
        seen = digest
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
