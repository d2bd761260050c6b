"""Selecting, ordering, splitting and reversing rows. Random choices are md5 orders of (seed, id), so they do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators.numbering import percentile


def turn(seed: int | str, *ids: str) -> Column:
    """The seeded order of rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def above_percentile(df: DataFrame, score: str, percent: float, by: list[str] | None = None) -> DataFrame:
    """Rows whose score is greater than the interpolated percentile; null scores never are.

    Over the whole table the percentile comes from counts of narrowing ranges; within groups (``by``) from the distinct values of each.
    """
    if not by:
        return df.where(F.col(score) > F.lit(percentile(df, score, percent / 100)).cast("double"))
    cut = df.groupBy(*by).agg(F.percentile(score, F.lit(percent / 100)).alias("_cut"))
    return df.join(cut, by).where(F.col(score) > F.col("_cut")).drop("_cut")


def _first(df: DataFrame, n: int, by: list[str] | None, *order: Column) -> DataFrame:
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def highest(df: DataFrame, score: str, n: int, id_column: str, by: list[str] | None = None) -> DataFrame:
    return _first(df, n, by, F.col(score).desc_nulls_last(), F.col(id_column))


def soonest(df: DataFrame, n: int, id_column: str, by: list[str] | None = None) -> DataFrame:
    return _first(df, n, by, F.col(id_column))


def random(df: DataFrame, n: int, id_column: str, seed: int, by: list[str] | None = None) -> DataFrame:
    return _first(df, n, by, turn(seed, id_column), F.col(id_column))


def shuffled(df: DataFrame, id_column: str, seed: int) -> DataFrame:
    """Global seeded order: a range partitioning, not a single task."""
    return df.orderBy(turn(seed, id_column), id_column)


def train_test(df: DataFrame, id_column: str, test: float, seed: int) -> DataFrame:
    """Add split; exactly ``test`` rows (over 1) or that share of all rows (up to 1) are 'test'.

    The cut in md5 order is found from counts per leading hex digits; only the bucket in which it falls is ranked.
    """
    rows = df.withColumn("_t", turn(seed, id_column)).withColumn("_b", F.substring("_t", 1, 3))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    all_rows = Window.partitionBy(F.lit(1))
    upto = counts.withColumn("_upto", F.sum("_n").over(all_rows.orderBy("_b"))).withColumn("_all", F.sum("_n").over(all_rows))
    wanted = F.least(F.lit(int(test)), F.col("_all")) if test > 1 else F.floor(F.col("_all") * test + 1e-9)
    upto = upto.select("_b", (wanted - F.col("_upto") + F.col("_n")).alias("_left"), "_n")  # test rows still to take in this bucket
    placed = rows.join(upto, "_b")
    inside = placed.where((F.col("_left") > 0) & (F.col("_left") < F.col("_n")))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_t", id_column))).withColumn("split", F.when(F.col("_r") <= F.col("_left"), "test").otherwise("train"))
    other = placed.where((F.col("_left") <= 0) | (F.col("_left") >= F.col("_n"))).withColumn("split", F.when(F.col("_left") > 0, "test").otherwise("train"))
    return other.unionByName(ranked.drop("_r")).select(*df.columns, "split")


def both_directions(pairs: DataFrame) -> DataFrame:
    """Pairs and their reverses, with the language columns swapped as well."""
    back = {"source": "target", "target": "source", "source_language": "target_language", "target_language": "source_language"}
    return pairs.unionByName(pairs.select(*[F.col(back.get(c, c)).alias(c) for c in pairs.columns]))


def best_by(df: DataFrame, keys: list[str], value: str, lower_is_better: Column, carry: list[str]) -> DataFrame:
    """The row with the best value per key; the smallest carried columns on ties."""
    signed = F.when(lower_is_better, F.col(value)).otherwise(-F.col(value))
    best = F.min(F.struct(signed.alias("_s"), *carry, value)).alias("_m")
    return df.groupBy(*keys).agg(best).select(*keys, *[f"_m.{c}" for c in carry], f"_m.{value}")
