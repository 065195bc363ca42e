"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.llm.spill import Scratch


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``edges`` (a, b); nulls and loops are ignored.

    Each round is two group-bys with partial aggregation and a join back, its table written to the shared folder; the
    number of rounds grows with the logarithm of the longest path. Nothing of the graph comes to the driver but counts.
    """
    scratch = Scratch(edges.sparkSession, "components")
    now = edges.where("a is not null and b is not null and a <> b")
    now = scratch.write(now.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    sign = None
    for step in itertools.count():
        # Large star: every larger neighbour of a node points to the smallest node around it.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        up = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = scratch.write(up.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"edges{step + 1}")
        scratch.drop(f"edges{step}")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        sign = seen
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = scratch.write(nodes.unionByName(roots), "found")
    scratch.drop(f"edges{step + 1}")
    return found
