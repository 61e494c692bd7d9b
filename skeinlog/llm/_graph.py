"""Connected components of an edge table, by minimum labels with pointer jumping.

Every round is a handful of joins and aggregates over written tables; nothing but a count of changed labels
reaches the driver. A node of very many edges is no special case: minima are combined before the shuffle, and both
sides of each join are scanned tables, which the adaptive skew join can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinlog.llm._tables import drop_table, write_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; component is the smallest node that it reaches."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = write_table(pairs.unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))), "edges")
    labels = write_table(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("c")), "labels")
    while True:
        old = labels
        offered = both.join(old.select(F.col("u").alias("v"), "c"), "v").select("u", "c")
        lower = write_table(old.unionByName(offered).groupBy("u").agg(F.min("c").alias("c")), "labels")
        jumped = lower.join(lower.select(F.col("u").alias("c"), F.col("c").alias("cc")), "c").select("u", F.col("cc").alias("c"))
        labels = write_table(jumped, "labels")
        changed = labels.alias("x").join(old.alias("y"), "u").where("x.c <> y.c").limit(1).count()
        drop_table(lower)
        drop_table(old)
        if not changed:
            drop_table(both)
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
