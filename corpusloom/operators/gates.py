"""Quality gates: projections that measure and filters that keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def word_gate(df: DataFrame, column: str = "text", more_than: int = 2) -> DataFrame:
    """Rows with more words (between single blanks) than ``more_than``."""
    return df.where(F.size(T.words_by_space(F.col(column))) > more_than)


def bigram_count(column: Column) -> Column:
    return T.highest_count(T.bigrams(T.words(column)))


def char_bigram_count(column: Column) -> Column:
    """Highest count of a character bigram in the longest word; 0 for a single character."""
    return T.highest_count(T.char_bigrams(T.longest_word(column)))


def repetition_gates(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows that pass all repetition gates; the cheap ones first, the pair gate only on what they leave."""
    cheap = word_gate(df, column).where(bigram_count(F.col(column)) < T.REPEAT_LIMIT).where(char_bigram_count(F.col(column)) < T.REPEAT_LIMIT)
    return cheap.where(T.highest_pair_count(F.col(column)) < T.PAIR_LIMIT)


def source_gate(df: DataFrame, is_language: Column, column: str = "text", least: int = 40) -> DataFrame:
    return df.where(is_language & (F.length(column) >= least))


def translation_gate(df: DataFrame, is_language: Column, column: str, least: int = 40) -> DataFrame:
    """In the target language, long enough, and ending in a full stop."""
    return df.where(is_language & (F.length(column) >= least) & F.endswith(T.strip(F.col(column)), F.lit(".")))


def gate_nested(df: DataFrame, is_good, arrays: list[str]) -> DataFrame:
    """Filter parallel arrays in lock-step by is_good(struct of one element of each); every row stays."""
    zipped = F.filter(F.arrays_zip(*arrays), is_good)
    return df.withColumns({a: zipped[a] for a in arrays})


def pair_gate(df: DataFrame, source: str = "source", target: str = "target", least: int = 10) -> DataFrame:
    """Both sides trimmed at least so long, and neither with '#' or '>'."""
    ok = F.lit(True)
    for c in (source, target):
        ok = ok & (F.length(T.strip(F.col(c))) >= least) & ~F.contains(F.col(c), F.lit("#")) & ~F.contains(F.col(c), F.lit(">"))
    return df.where(ok)


def premise_gate(df: DataFrame, column: str, in_target: Column | None, in_source: Column) -> DataFrame:
    """Child translations that are not blank, in the target language (where that can be told) and not in the source language."""
    good = (T.strip(F.col(column)) != "") & ~in_source
    return df.where(good & in_target if in_target is not None else good)


def complete_runs(df: DataFrame, n: int, run: str = "run", order: str = "row_id") -> DataFrame:
    """Runs with at least n predictions, cropped to the first n."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(run)
    numbered = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_i", F.row_number().over(w.orderBy(order)))
    return numbered.where((F.col("_n") >= n) & (F.col("_i") <= n)).drop("_n", "_i")
