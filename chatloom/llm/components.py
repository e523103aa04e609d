"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated before the shuffle, so a hub of any degree is safe) and a join of
the edges with those minima; both sides are written tables, so a hub's edges are split by Spark's skew join.
The number of steps grows with the logarithm of the longest path, and none is made once the edges are stars; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.session import written


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges as (u, v) with v < u, each once."""
    u, v = F.greatest("u", "v"), F.least("u", "v")
    return edges.filter("u <> v").select(u.alias("u"), v.alias("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u: nothing is left to do."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.  ``edges``: u, v, both long."""
    now = written(_ordered(edges.select("u", "v")), "cc-edges")
    for step in range(most_steps):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"cc-large-{step}")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(_ordered(large), f"cc-star-{step}")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"cc-small-{step}")
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        now = written(_ordered(small), f"cc-next-{step}")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
