"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipoff.session import pinned


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(`node`, `root`) for each node of the edges that is not a root itself; the root is the least node.

    Alternating large and small stars: each round links the neighbours of a node to the least of them, and the
    edges shrink to one star per component in about log n rounds. Sums are combined before each shuffle and the
    joins are plain equi-joins, whose hot keys adaptive execution splits. Each round is cut by a checkpoint.
    Loops, repeated edges and nulls are ignored.
    """
    lo, hi = F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")
    now = pinned(edges.where(F.col(a) != F.col(b)).select(lo, hi).distinct())
    mark = None
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(root, "hi")
        now = pinned(
            small.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .union(root.select(F.col("m").alias("lo"), "hi"))
            .distinct()
        )
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
