"""Rounds of generation, parsing, gating and near-duplicate removal, and the back-translation job behind them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import prompts as PR
from corpusloom.functions import text as T
from corpusloom.operators import gates as G
from corpusloom.operators import similarity as S
from corpusloom.operators.inference import Backend, EchoBackend, Sampling, generate
from corpusloom.operators.reshape import nested


def new_paragraphs(seeds: DataFrame, kept: DataFrame, prompt: Column, n: int, factory: Callable[[], Backend] = EchoBackend, tau: float = 0.7) -> DataFrame:
    """language, topic, text of one round: generated, parsed, gated, and unlike what is kept (language, text) and each other.

    ``seeds`` has language and topic; answers with another number of items than n are rejected as a whole.
    """
    asked = seeds.select("language", "topic", prompt.alias("prompt"))
    answers = generate(asked, "prompt", factory, Sampling())
    joined = asked.join(answers.select("prompt", F.get("candidates", F.lit(0)).alias("answer")), "prompt")
    items = joined.select("language", "topic", F.explode(T.numbered_items(F.col("answer"), F.lit(n))).alias("text"))
    clean = G.repetition_gates(items.withColumn("text", T.without_placeholders(T.flattened(F.col("text")))))
    S.use_shared_checkpoints(kept.sparkSession)
    fresh = clean.groupBy("language", "text").agg(F.min("topic").alias("topic"), F.lit(1).alias("new")).checkpoint()
    old = kept.select("language", "text", F.lit(None).cast("string").alias("topic"), F.lit(0).alias("new"))
    # what is kept already comes first; new rows follow in md5 order
    ranked = old.unionByName(fresh).withColumn("doc_id", F.concat(F.col("new").cast("string"), F.md5(F.concat_ws("|", "language", "text"))))
    unlike = S.greedy_unlike(ranked.withColumn("t", T.ascii_tokens(F.col("text"))), "t", tau, "language").where("new = 1").select("language", "topic", "text")
    # rows without tokens or language are near nothing: only those that equal a kept one go
    told = F.coalesce(F.col("language").isNotNull() & F.lower("text").rlike("[a-z0-9]"), F.lit(False))
    mute = kept.where(~told).select(F.col("language").alias("l"), F.col("text").alias("x")).distinct()
    return unlike.join(mute, F.col("language").eqNullSafe(F.col("l")) & F.col("text").eqNullSafe(F.col("x")), "left_anti")


def run_rounds(seeds: DataFrame, kept: DataFrame, make_prompt: Callable[[int], Column], n: int, wanted: int, most_empty: int = 50, save: Callable[[DataFrame], DataFrame] | None = None, factory: Callable[[], Backend] = EchoBackend) -> DataFrame:
    """Rounds until ``wanted`` rows are kept or ``most_empty`` rounds in a row bring none. ``save`` writes a round and returns what is kept so far, read back."""
    S.use_shared_checkpoints(kept.sparkSession)
    empty, r = 0, 0
    while kept.count() < wanted and empty < most_empty:
        fresh = new_paragraphs(seeds, kept, make_prompt(r), n, factory)
        before = kept.count()
        kept = save(fresh) if save else kept.unionByName(fresh.select(*kept.columns)).checkpoint()
        empty = empty + 1 if kept.count() == before else 0
        r += 1
    return kept


def back_translations(paragraphs: DataFrame, id_column: str, is_source: Column, is_target: Column, factory: Callable[[], Backend] = EchoBackend, prompt: Callable[[Column], Column] | None = None) -> DataFrame:
    """id, propositions, translations per paragraph; paragraphs without a sentence that passes the gates keep empty arrays."""
    rows = paragraphs.select(id_column, F.posexplode(T.sentences(F.col("text"))).alias("pos", "text"))
    rows = G.source_gate(rows, is_source).withColumn("prompt", (prompt or (lambda c: c))(F.col("text")))
    out = generate(rows, "prompt", factory).select("prompt", F.get("candidates", F.lit(0)).alias("translation"))
    pairs = G.translation_gate(rows.join(out, "prompt"), is_target, "translation")
    return nested(pairs.select(id_column, "pos", F.col("text").alias("propositions"), F.col("translation").alias("translations")), id_column, ["propositions", "translations"], paragraphs)


def neighbours_round(pool: DataFrame, k: int, factory: Callable[[], Backend] = EchoBackend) -> DataFrame:
    """One answer per row of the pool (item_id, text, v) from a prompt of its k nearest neighbours, itself excluded."""
    near = S.dense_top_k(pool.select(F.col("item_id").alias("query_id"), F.col("v").alias("q")), pool.select("item_id", "v"), k, exclude_self=True)
    shots = near.join(pool.select("item_id", "text"), "item_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"].alias("examples"))
    asked = shots.withColumn("prompt", PR.neighbour_prompt(F.col("examples")))
    answers = generate(asked, "prompt", factory).select("prompt", F.get("candidates", F.lit(0)).alias("answer"))
    line = F.get(F.split(T.strip(F.col("answer")), "\n"), F.lit(0))
    return asked.join(answers, "prompt").select("query_id", line.alias("text"))
