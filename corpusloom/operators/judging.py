"""Comparisons of strategies and systems: pairs of runs, segment and system scores, pairwise rankers and judges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.inference import Backend, EchoBackend, generate


def strategy_pairs(df: DataFrame, by: list[str], strategy: str = "strategy") -> DataFrame:
    """by, a, b: every unordered pair of different strategies of a group once, a before b in order of name."""
    names = df.select(*by, strategy).distinct()
    other = names.withColumnRenamed(strategy, "b")
    return names.withColumnRenamed(strategy, "a").join(other, by).where("a < b").select(*by, "a", "b")


def segment_pairs(df: DataFrame, by: list[str], row: str, strategy: str, value: str) -> DataFrame:
    """by, row, a, b, value_a, value_b: the segments of two strategies side by side, for every pair of them (strategies are few)."""
    left = df.select(*by, row, F.col(strategy).alias("a"), F.col(value).alias(f"{value}_a"))
    right = df.select(*by, row, F.col(strategy).alias("b"), F.col(value).alias(f"{value}_b"))
    return left.join(right, [*by, row]).where("a < b").select(*by, row, "a", "b", f"{value}_a", f"{value}_b")


def system_scores(df: DataFrame, by: list[str], value: str, places: int | None = None) -> DataFrame:
    """by, n, score: the mean of segment scores, rounded if asked for; segments without a score do not count."""
    mean = F.avg(value)
    return df.groupBy(*by).agg(F.count(value).alias("n"), (mean if places is None else F.round(mean, places)).alias("score"))


def win_rates(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """by, wins, losses, ties of the first value over the second."""
    count = lambda c: F.sum(c.cast("long"))
    return pairs.groupBy(*by).agg(count(F.col(a) > F.col(b)).alias("wins"), count(F.col(a) < F.col(b)).alias("losses"), count(F.col(a) == F.col(b)).alias("ties"))


def ranker_input(source: Column, a: Column, b: Column) -> Column:
    """Fixed form: what a pairwise ranker reads."""
    return F.concat(F.lit("Source: "), T.strip(source), F.lit(" Translation 0: "), T.strip(a), F.lit(" Translation 1: "), T.strip(b))


class Ranker(Protocol):
    """Two numbers per text, for the first and the second translation."""

    def compare(self, texts: list[str]) -> list[tuple[float, float]]: ...


class LongerRanker:
    """A deterministic offline ranker: prefers the longer translation."""

    def compare(self, texts: list[str]) -> list[tuple[float, float]]:
        out = []
        for t in texts:
            a, _, b = t.partition(" Translation 0: ")[2].partition(" Translation 1: ")
            out.append((float(len(a)), float(len(b))))
        return out


def rank_pairs(df: DataFrame, source: str, a: str, b: str, factory: Callable[[], Ranker] = LongerRanker, batch_size: int = 64) -> DataFrame:
    """Add winner: 'A' or 'B', the translation that the ranker prefers; 'A' if both are equal, null where an input is null."""
    rows = df.withColumn("_input", ranker_input(F.col(source), F.col(a), F.col(b)))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = factory()
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_size):
                part = batch.slice(lo, batch_size)
                texts = part.column(part.num_columns - 1).to_pylist()
                values = iter(ranker.compare([t for t in texts if t is not None]))
                said = [None if t is None else "AB"[int(x[1] > x[0])] for t in texts for x in [next(values) if t is not None else (0, 0)]]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(said, pa.string())], names=[*part.schema.names[:-1], "winner"])

    return rows.mapInArrow(run, f"{kinds}, winner string")


def topic_judge_prompt(text: Column, language: Column, topic: Column) -> Column:
    """Asks whether a paragraph is about a topic; the answer stands between <answer> tags."""
    return F.concat(
        F.lit("Read this "), language, F.lit(" paragraph.\n<paragraph>\n"), text, F.lit("\n</paragraph>\nIs it about this topic?\n<topic>\n"), topic,
        F.lit("\n</topic>\nReason inside <reasoning> tags, then write Yes or No inside <answer> tags and stop."),
    )


def yes_or_no(answer: Column) -> Column:
    """True, False or null from the last <answer> of a judge, whatever its case."""
    said = F.lower(T.strip(F.regexp_extract(answer, r"(?s).*<answer>\s*([A-Za-z]+)", 1)))
    return F.when(said == "yes", True).when(said == "no", False)


def topic_alignment(df: DataFrame, text: str, translations: str, language: str, topic: str, factory: Callable[[], Backend] = EchoBackend, pivot: str = "English") -> DataFrame:
    """Add source_on_topic and target_on_topic: whether a paragraph, and its sentences' translations joined by blanks, are about the topic. Every row is judged."""
    asked = df.withColumns(
        {
            "_s": topic_judge_prompt(F.col(text), F.col(language), F.col(topic)),
            "_t": topic_judge_prompt(F.array_join(translations, " "), F.lit(pivot), F.col(topic)),
        }
    )
    answers = generate(asked.select("_s").union(asked.select("_t")), "_s", factory)
    said = answers.select("prompt", yes_or_no(F.get("candidates", F.lit(0))).alias("said"))
    out = asked.join(said.select(F.col("prompt").alias("_s"), F.col("said").alias("source_on_topic")), "_s", "left")
    return out.join(said.select(F.col("prompt").alias("_t"), F.col("said").alias("target_on_topic")), "_t", "left").drop("_s", "_t")
