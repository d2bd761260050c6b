"""Positions and running totals over a whole ordered table, and exact percentiles, without a task that sees all rows.

A prefix sum in two levels: rows are range-partitioned and sorted by their order, every task counts and sums its own part, and what
comes before a part is added from the totals of the parts, of which there are as many as tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

LARGEST = 8.9e307
FEW = 1000  # values of a percentile's range that are looked at one by one
BINS = 2048


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder of spark.checkpoint.dir; only a session of local mode has one of our own without it."""
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "/tmp/checkpoints/corpusloom-core")


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The part's number, and rows and sizes before each row within the part, in place of the last column (the size)."""
    part, rows, total = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        size = np.nan_to_num(batch.columns[-1].to_numpy(zero_copy_only=False)).astype(np.int64)
        upto = np.cumsum(size)
        added = [pa.array(np.full(n, part)), pa.array(np.arange(rows, rows + n)), pa.array(total + upto - size), pa.array(size)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], *ADDED])
        rows, total = rows + n, total + int(upto[-1]) if n else total


ADDED = ("_part", "_row", "_before", "_size")


def running(df: DataFrame, order: list[str], size: Column | None = None, number: str = "number", before: str = "before") -> DataFrame:
    """Add ``number``, the row's place from 0 in ``order``, and ``before``, the sum of ``size`` over all rows ahead of it (null sizes count as 0).

    The ordered table is checkpointed once, so that a repeated task cannot order rows anew. Rows of equal order are told apart in no fixed way and meet in
    one task: end ``order`` with something that is different in every row. An empty table stays empty.
    """
    use_shared_checkpoints(df.sparkSession)
    sized = df.withColumn("_s", (F.lit(1) if size is None else size).cast("long"))
    kinds = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in ADDED)])
    local = sized.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_local, kinds).checkpoint()
    totals = local.groupBy("_part").agg(F.count(F.lit(1)).alias("rows"), F.sum("_size").alias("total")).orderBy("_part").collect()  # one row per task
    starts, rows, total = [], 0, 0
    for r in totals:
        starts.append((r["_part"], rows, total))
        rows, total = rows + r["rows"], total + r["total"]
    begin = df.sparkSession.createDataFrame(starts, "_part long, _rows long, _total long")
    placed = local.join(F.broadcast(begin), "_part")
    return placed.select(*df.columns, (F.col("_rows") + F.col("_row")).alias(number), (F.col("_total") + F.col("_before")).alias(before))


def percentile(df: DataFrame, value: str, share: float) -> float | None:
    """The interpolated percentile of a column, exact, null without values.

    The range in which the value lies is narrowed by counts over equal bins, of all rows in every pass, until few or equal values are left; values are never gathered or sorted
    as a whole. Null and NaN are no values, and infinite ones count as the largest finite numbers.
    """
    rows = df.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    rows = rows.select(F.greatest(F.least("x", F.lit(LARGEST)), F.lit(-LARGEST)).alias("x"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None
    at = (n - 1) * share
    open_ = {r: (low, high, 0, n) for r in {int(np.floor(at)), int(np.ceil(at))}}  # rank: its range, rows below the range, rows in it
    found: dict[int, float] = {}
    while open_:
        for r, (lo, hi, below, inside) in list(open_.items()):
            if lo == hi:
                found[r] = lo
                del open_[r]
            elif inside <= FEW:
                own = sorted(v[0] for v in rows.where(F.col("x").between(lo, hi)).collect())
                found[r] = own[r - below]
                del open_[r]
        ranges = sorted(set(open_.values()))
        if not ranges:
            break
        which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi, _, _) in enumerate(ranges):
            own = F.col("x").between(lo, hi)
            which = F.when(own, i).otherwise(which)
            bin_ = F.when(own, F.least(F.floor((F.col("x") - lo) / (hi - lo) * BINS), F.lit(BINS - 1)).cast("int")).otherwise(bin_)
        made = rows.select(which.alias("i"), bin_.alias("b"), "x").where("i is not null").groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        bins = sorted(made.collect())  # a few thousand at most
        for r, old in list(open_.items()):
            below = old[2]
            for i, _, m, lo, hi in bins:
                if ranges[i] == old:
                    if r < below + m:
                        open_[r] = (lo, hi, below, m)
                        break
                    below += m
    lo, hi = found[int(np.floor(at))], found[int(np.ceil(at))]
    return lo + (hi - lo) * (at - np.floor(at))
