"""Connected components by alternating large-star and small-star steps, all in Spark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from smishlake.llm.common import store

#: Parts in which the rows of a node meet what is known of it, so that a hub is no single task.
DEAL = 8


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with m, the least v of each u. The least is found by partial sums and met in DEAL parts."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(DEAL)).cast("int"))
    return dealt.join(least.hint("merge"), ["u", "part"]).drop("part")


def _large(edges: DataFrame) -> DataFrame:
    """Each node hands the least of itself and its neighbours to the neighbours above it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its lower neighbours to the others, and keeps it."""
    least = edges.groupBy("u").agg(F.min("v").alias("v"))
    passed = _with_least(edges).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return passed.unionByName(least).filter("u <> v").distinct()


def _digest() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node reachable) for every node that has an edge to another node.

    Each round writes its edges to the shared folder. The number of rounds grows with the logarithm of the longest chain;
    a round only ever replaces edges by at most as many.
    """
    e = store(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc-edges")
    seen = None
    while True:
        e = store(_small(_large(e)), "cc-round")
        row = e.agg(*_digest()).first()
        if (row["n"], row["h"]) == seen or row["n"] == 0:
            break
        seen = (row["n"], row["h"])
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return store(stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component")), "cc-nodes")
