"""Benchmark decontamination by shared n-grams."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T


def _hashed(tokens, n: int):
    """Distinct 64-bit hashes of the runs of n tokens: tokens are hashed once, runs by the hashes of their tokens."""
    single = F.transform(tokens, lambda w: F.xxhash64(w))

    def grams(h):
        at = F.sequence(F.lit(0), F.size(h) - n)
        return F.when(F.size(h) >= n, F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))).otherwise(F.array().cast("array<bigint>"))

    return T.let(single, grams)


def _long_enough(df: DataFrame, text_column: str, n: int) -> DataFrame:
    """Without texts that cannot hold n tokens; they are not tokenised."""
    return df.where(F.length(text_column) >= 2 * n - 1)


def ngram_index(bench: DataFrame, id_column: str = "item_id", text_column: str = "text", n: int = 10) -> DataFrame:
    """n-gram and its hash to the last item that holds it."""
    grams = F.explode(T.ngrams(T.normalised_tokens(F.col(text_column)), n)).alias("ngram")
    rows = _long_enough(bench, text_column, n).select(id_column, grams).groupBy("ngram").agg(F.max(id_column).alias(id_column))
    return rows.withColumn("gram", F.get(_hashed(F.split("ngram", " "), n), F.lit(0)))


def contamination(df: DataFrame, index: DataFrame, id_column: str = "doc_id", text_column: str = "text", item: str = "item_id", n: int = 10) -> DataFrame:
    """id, ngram, item of every text that shares an n-gram: its first shared n-gram in byte order.

    Only fixed-width hashes of the corpus's n-grams are made and joined (whichever side is small enough is broadcast by the planner); the n-grams
    themselves are looked for in the texts that match.
    """
    rows = _long_enough(df, text_column, n).select(id_column, F.explode(_hashed(T.normalised_tokens(F.col(text_column)), n)).alias("gram"))
    found = rows.join(index, "gram").select(id_column, "ngram", item)
    met = df.join(found.select(id_column).distinct(), id_column, "left_semi")  # only texts that met an item are tokenised again
    said = met.select(id_column, F.concat(F.lit(" "), F.array_join(T.normalised_tokens(F.col(text_column)), " "), F.lit(" ")).alias("_said"))
    hits = found.join(said, id_column).where(F.contains("_said", F.concat(F.lit(" "), F.col("ngram"), F.lit(" "))))
    return hits.groupBy(id_column).agg(F.min(F.struct("ngram", item)).alias("hit")).select(id_column, "hit.ngram", f"hit.{item}")


def without_contaminated(df: DataFrame, hits: DataFrame, on: str = "doc_id") -> DataFrame:
    return df.join(hits.select(on), on, "left_anti")


def without_contaminated_elements(df: DataFrame, bad: DataFrame, id_column: str, arrays: list[str]) -> DataFrame:
    """Drop the positions (id, pos) of ``bad`` from parallel arrays; rows stay even if nothing is left."""
    gone = bad.groupBy(id_column).agg(F.collect_set("pos").alias("_gone"))
    joined = df.join(gone, id_column, "left")
    kept = F.filter(
        F.transform(F.arrays_zip(*arrays), lambda z, i: F.struct(i.alias("i"), z.alias("z"))),
        lambda s: ~F.coalesce(F.array_contains(F.col("_gone"), s["i"]), F.lit(False)),
    )
    return joined.withColumns({a: F.transform(kept, lambda s: s["z"])[a] for a in arrays}).drop("_gone")


MATCHING = "diff array<string>, diff_ratio double, diff_length int, longest_diff_part string, longest_diff_part_length int"


def _matching(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    out = []
    for x, y in zip(a.str.lower(), b.str.lower(), strict=True):
        blocks = [y[m.b : m.b + m.size] for m in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks() if m.size > 5]
        total, longest = sum(map(len, blocks)), max(blocks, key=len, default="")
        out.append((blocks, total / len(y) if y else 0.0, total, longest, len(longest)))
    return pd.DataFrame(out, columns=["diff", "diff_ratio", "diff_length", "longest_diff_part", "longest_diff_part_length"])


def contamination_report(df: DataFrame, bench: DataFrame, n: int = 10) -> DataFrame:
    """Hits with the matching blocks (over five characters) of text and item; only texts that hit reach Python."""
    hits = contamination(df, ngram_index(bench, n=n), n=n)
    full = hits.join(df.select("doc_id", F.col("text").alias("completion")), "doc_id").join(bench.select("item_id", F.col("text").alias("bench_text")), "item_id")
    matching = F.pandas_udf(_matching, MATCHING)
    return full.withColumn("m", matching("completion", "bench_text")).select("doc_id", "item_id", "ngram", "completion", "bench_text", "m.*")
