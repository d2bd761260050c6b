"""Packing token sequences into blocks of constant length, and label masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.numbering import running

IGNORED = -100


def offsets(df: DataFrame, order: str, size: Column) -> DataFrame:
    """Add offset, the running total of ``size`` over all rows before, in the order of a column."""
    return running(df, [order], size, "_number", "offset").drop("_number")


def packed(df: DataFrame, order: str, tokens: str, block: int, keep_tail: bool = False) -> DataFrame:
    """block_id, tokens: all token arrays end to end, cut into blocks; what does not fill the last block goes.

    Every array is cut into its fragments per block, so rows of fragments are shuffled, never single tokens.
    """
    placed = offsets(df.select(order, tokens), order, F.size(tokens)).where(F.size(tokens) > 0)
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.size(tokens) - 1) / block)
    pieces = placed.withColumn("block_id", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block_id") * block - F.col("offset"), F.lit(0)).cast("int")
    hi = F.least((F.col("block_id") + 1) * block - F.col("offset"), F.size(tokens).cast("long")).cast("int")
    pieces = pieces.select("block_id", (F.col("offset") + lo).alias("at"), F.slice(tokens, lo + 1, hi - lo).alias("piece"))
    blocks = pieces.groupBy("block_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "piece")))["piece"]).alias("tokens"))
    return blocks if keep_tail else blocks.where(F.size("tokens") == block)


def target_labels(prompt: Column, target: Column, end: Column) -> tuple[Column, Column]:
    """input_ids and labels of a pair: the prompt's labels are masked, the end token is learned."""
    ids = F.concat(prompt, target, F.array(end))
    return ids, F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), target, F.array(end))


def padded(ids: Column, length: int, pad: int) -> Column:
    """Cut or filled to a length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))), 1, length)


def characters_per_token(df: DataFrame, text: str, tokens: Column, order: str, first: int = 400) -> DataFrame:
    """Ratio of sums over the first rows."""
    head = df.orderBy(order).limit(first)
    return head.agg((F.sum(F.length(text)) / F.sum(F.size(tokens))).alias("chars_per_token"))
