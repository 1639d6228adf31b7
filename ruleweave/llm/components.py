"""Connected components by alternating star contractions (Kiveris et al., 2014), all in DataFrames.

Every round is written to the shared folder and read back, so nothing of the
graph reaches the driver but its size.  A node with a third of all edges is no
trouble: minima are combined before the shuffle, and the joins' hot keys meet
one row each, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _least(pairs: DataFrame) -> DataFrame:
    """(u, m): the least of u and its neighbours v."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long); root is the component's least node."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        # Large star: neighbours greater than u hang on the least neighbour.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # Small star: neighbours not greater than u, and u, hang on their least.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        drop_cut(e)
        e = after
        was, state = state, tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        if was == state:
            break
    # At rest every edge is (node, least node of its component).
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
