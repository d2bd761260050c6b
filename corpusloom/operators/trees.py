"""Decompose, translate, merge: text trees as one table (level, node_id, parent_id, root_id, pos, text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREE = ["level", "node_id", "parent_id", "root_id", "pos", "text"]


def roots(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """Level 0: one node per row, its own root."""
    node = F.col(id_column).cast("string")
    return df.select(F.lit(0).alias("level"), node.alias("node_id"), F.lit(None).cast("string").alias("parent_id"), node.alias("root_id"), F.lit(0).alias("pos"), F.col(text).alias("text"))


def decompose(nodes: DataFrame, split: Callable[[Column], Column], levels: int) -> DataFrame:
    """All levels down: the last level is split again, ``levels`` times. The root goes along, so no join climbs the tree."""
    out, last = nodes, nodes
    for level in range(1, levels + 1):
        children = last.select("node_id", "root_id", F.posexplode(split(F.col("text"))).alias("pos", "text"))
        last = children.select(
            F.lit(level).alias("level"), F.concat_ws(".", "node_id", F.col("pos").cast("string")).alias("node_id"), F.col("node_id").alias("parent_id"), "root_id", "pos", "text"
        )
        out = out.unionByName(last)
    return out


def merge_up(nodes: DataFrame, leaf: Callable[[Column], Column], merge: Callable[[Column, Column, Column], Column], levels: int) -> DataFrame:
    """root_id, result: leaves are translated, then level by level a node's result comes from its text, its children's texts and results in order.

    Children with blank results are left out as premises; nodes without children are translated themselves.
    """
    done = nodes.where(F.col("level") == levels).select("node_id", "parent_id", "pos", "text", leaf(F.col("text")).alias("result"))
    for level in range(levels - 1, -1, -1):
        premises = done.where(F.trim("result") != "").groupBy(F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("pos", "text", "result"))).alias("kids"))
        here = nodes.where(F.col("level") == level).join(premises, "node_id", "left")
        result = F.when(F.col("kids").isNull(), leaf(F.col("text"))).otherwise(merge(F.col("text"), F.col("kids.text"), F.col("kids.result")))
        done = here.select("node_id", "parent_id", "pos", "text", result.alias("result"))
    return done.select(F.col("node_id").alias("root_id"), "result")
