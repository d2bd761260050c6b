"""Nesting, flattening, positional joins and run-length operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def flattened(df: DataFrame, key: str, arrays: list[str]) -> DataFrame:
    """key, pos and one row per position of parallel arrays."""
    return df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "z")).select(key, "pos", *[F.col(f"z.{a}").alias(a) for a in arrays])


def nested(rows: DataFrame, key: str, columns: list[str], parents: DataFrame | None = None) -> DataFrame:
    """Arrays in order of pos per key; with ``parents``, keys without rows get empty arrays."""
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("_r"))
    out = grouped.select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    if parents is None:
        return out
    kinds = {f.name: f.dataType for f in out.schema.fields}
    return parents.select(key).join(out, key, "left").withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in columns})


def zipped(left: DataFrame, right: DataFrame, on: list[str], suffixes: tuple[str, str] = ("source", "target"), value: str = "sentence") -> DataFrame:
    """Rows with equal positions side by side."""
    return left.withColumnRenamed(value, suffixes[0]).join(right.select(*on, F.col(value).alias(suffixes[1])), on)


def run_heads(df: DataFrame, order: str, value: str, by: str) -> DataFrame:
    """The first row of every run of equal trimmed values, in the order of ``order`` within ``by``."""
    trimmed = F.trim(F.col(value))
    before = F.lag(trimmed).over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != trimmed)).drop("_before")


def not_done(df: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows whose id is not in the output yet: resumption that does not depend on order."""
    return df.join(done.select(on).distinct(), on, "left_anti")


def interleaved(df: DataFrame, key: str, item: str, rank: str, part: str, k: int) -> DataFrame:
    """Round-robin over parts, each item once at its best rank, the first k."""
    best = df.groupBy(key, item).agg(F.min(F.struct(rank, part)).alias("b"))
    w = Window.partitionBy(key).orderBy(f"b.{rank}", f"b.{part}", item)
    return best.withColumn("pos", F.row_number().over(w).cast("long")).where(F.col("pos") <= k).select(key, item, "pos")


def long_series(df: DataFrame, keys: list[str], series: list[str]) -> DataFrame:
    """Arrays of values by step as rows (keys, metric, step from 1, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("metric"), F.col(s).alias("values")) for s in series])).alias("m")
    return df.select(*keys, pairs).select(*keys, "m.metric", F.posexplode("m.values").alias("step", "value")).withColumn("step", F.col("step") + 1)
