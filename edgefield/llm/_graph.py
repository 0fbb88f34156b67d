"""Connected components of a table of links, by alternating large and small stars.

Each round points every node at the smallest id among its neighbours, first from the larger side, then from the smaller one,
until the links form stars. Minima are taken before the shuffle, and the joins on a node can be split by Spark where one node
has very many links. Every round is written to the shared folder, so that lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import forget, written


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: columns a, b (long). Returns node, component for every node that has a link to another: the smallest id it reaches.

    Self-links and repeated links change nothing; links with a null end count for nothing; no links give no rows."""
    now = written(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    while True:
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
        both = now.select(F.col("u").alias("x"), F.col("v").alias("y")).union(now.select("v", "u"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", F.col("m").alias("v"))).distinct()
        then = written(small, name)
        forget(now)
        now = then
