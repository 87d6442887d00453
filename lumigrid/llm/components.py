"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (u, v). Returns (node, component): every node but a component's smallest one, with that smallest one.

    A round points each node's larger neighbours at the smallest node it knows (large star), then each node and
    its smaller neighbours at the smallest of them (small star). Minima are pre-aggregated, so a hub with very
    many neighbours costs no more than its edges. Rounds grow with the logarithm of the longest path; each is
    written to the shared folder.
    """
    now = common.table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v")
        before, now = now, common.table(small.distinct(), "edges")
        common.drop(before)
