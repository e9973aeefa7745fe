"""Connected components of a link table by alternating large-star and small-star rounds: every
round is a few aggregates and equi-joins on (node, node) rows, written to the shared folder, so
nothing grows with a component's size but its own links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.session import written

#: Rounds fall with the logarithm of the longest chain; this many would take chains past any input.
ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (a, b): the smallest node it can reach."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                         .where("u > v").distinct(), "links")
    before = None
    for _ in range(ROUNDS):
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v"))).first()
        if state == before:
            break
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                      .unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, "links")
    else:
        raise RuntimeError("components did not settle")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
                 .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
