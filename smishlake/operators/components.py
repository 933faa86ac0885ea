"""Connected components of message links: min-label propagation over Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smishlake.sources.tables import persist_table


def min_label_components(edges: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """node, component (least node it is connected to). Each round joins labels over the edges and then jumps to the
    label's label, so rounds grow with the logarithm of the diameter; every round is written to the shared folder."""
    both = persist_table(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = persist_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "c").hint("merge"), "v").groupBy("u").agg(F.min("c").alias("m"))
        lower = labels.join(near.hint("merge"), "u").select("u", F.least("c", "m").alias("m"), F.col("c").alias("old"))
        jump = lower.join(labels.select(F.col("u").alias("m"), F.col("c").alias("j")).hint("merge"), "m", "left")
        new = persist_table(jump.select("u", F.least("m", F.coalesce("j", "m")).alias("c"), "old"), "labels")
        if new.filter("c <> old").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("c").alias("component"))
        labels = new.select("u", "c")
