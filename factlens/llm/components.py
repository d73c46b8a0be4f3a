"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step replaces the edges of a node by edges to its smallest neighbour, which keeps
the components; the number of steps grows with the logarithm of a component's length.
No edge or label comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of its component.

    edges: (a, b), longs in any order; loops and repeated edges are allowed, null ends
    are ignored.
    """
    # a step that changes nothing is told by the number of edges and a sum of their hashes
    state = (F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash"))
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, known = scratch.observed(e, f"{name}-0", *state)
    step = 0
    while known["n"]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.distinct(), f"{name}-large-{step}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = scratch.observed(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step + 1}", *state)
        scratch.drop(f"{name}-large-{step}", f"{name}-{step}")
        step += 1
        if now == known:
            break
        known = now
    roots = e.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
