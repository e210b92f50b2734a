"""Connected components of a graph of any size, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import written


def components(edges: DataFrame, work: str) -> DataFrame:
    """Columns ``node, root``: for each end of an edge ``(a, b)`` the smallest node it is linked to, directly or not.

    Each step is written to ``work``, which cuts the lineage. Minima are written before they are joined back, so that
    both sides of the join are plain exchanges and Spark can split the rows of a node with very many neighbours.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, f"{work}/edges")
    before, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{work}/large{step}")
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, f"{work}/star{step}")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{work}/small{step}")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{work}/edges{step}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, step = now, step + 1
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return written(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots), f"{work}/roots")
