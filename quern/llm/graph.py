"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) from long pairs (a, b): the component is its smallest node. Nodes without a pair are absent.

    Every step is a map-side combined minimum for each node and an inner join that adaptive execution can split at
    a hub; the result of each is written, so lost executors cost one step. The number of steps grows with the
    logarithm of the longest chain. A step's table is deleted when the next is written. Pairs with nulls, self-pairs and repeated pairs do no harm.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, state = written(e, "cc"), None
    for _ in range(limit):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        e, before = written(large, "cc"), e
        discard(before)
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        e, before = written(small, "cc"), e
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
