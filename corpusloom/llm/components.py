"""Connected components of an edge table by alternating large-star and small-star steps.

Only minima per node are aggregated; no neighbour list is ever gathered, and every step is staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import drop_stage, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (u, v).

    Defined results: steps go on until none changes an edge; repeated edges, both directions and loops change nothing, and a node that has only
    loops does not appear; rows with a null end are ignored; no edges give an empty result; other columns are ignored.
    """
    now = stage(edges.where("u <> v").select("u", "v").distinct(), "cc-edges")
    before, mark = (), None
    while mark != before:  # every step but the last brings some node closer to its smallest one
        before, old = mark, now
        now = stage(_small_star(_large_star(old)).where("u <> v").distinct(), "cc-edges")
        drop_stage(old)
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    stars = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(now.select("v", "v").distinct())
