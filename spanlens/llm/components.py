"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node it is connected with) for every node of edges (u, v) that has a partner.

    Every round takes the least neighbour of each node by a pre-aggregated minimum and hands it to the
    node's edges by an equi-join. Both sides of the joins are written tables, so each has an exchange of its
    own and adaptive execution can split a hub's edges. Tables that a round has replaced are removed.
    """
    now = scratch.write(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")))
        large = scratch.write(both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = scratch.write(large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")))
        small = large.join(low, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(small.unionByName(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        for used in (least, large, low):
            scratch.drop(used)
        scratch.drop(now)
        now, before = after, state
        state = _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """A fingerprint of the edge set: rounds end when it stands still."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
