"""Rounds that grow a set of texts from itself: prompts with sampled examples, answers parsed, gated and kept if unlike what is there; and rounds of neighbours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import prompts as PR
from corpusloom.functions import text as T
from corpusloom.operators import gates as G
from corpusloom.operators import similarity as S
from corpusloom.operators.inference import Backend, EchoBackend, embed, generate
from corpusloom.sources.corpora import numbered_rows

STRIDES = [1_000_000_007, 1_000_000_009, 1_000_000_021, 1_000_000_033]  # primes beyond any pool that is numbered, so steps of one never meet
SEPARATOR = "##"


def drawn(n: Column | int, count: Column, *key: Column) -> Column:
    """n different numbers below ``count`` (all of them, if there are fewer), in an order that the key fixes."""
    h = F.xxhash64(*key)
    stride = F.element_at(F.array(*[F.lit(p) for p in STRIDES]), (F.pmod(F.xxhash64(F.lit("stride"), *key), F.lit(len(STRIDES))) + 1).cast("int"))
    most = F.least(F.lit(n) if isinstance(n, int) else n, count.cast("int"))
    return F.when(most > 0, F.transform(F.sequence(F.lit(0), most - 1), lambda j: F.pmod(F.pmod(h, count) + j * F.pmod(stride, count), count).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def mixed_examples(asked: DataFrame, seeds: DataFrame, made: DataFrame, n: int, synthetic: int, seed: int = 122) -> DataFrame:
    """prompt_id, language, examples: n texts of the prompt's language, ``synthetic`` of them made ones, or all seeds where there are too few made ones; shuffled.

    ``asked`` has prompt_id and language; ``seeds`` and ``made`` have language and text. Texts are drawn without replacement by number, never gathered.
    """
    pools = numbered_rows(seeds.withColumn("kind", F.lit("seed")).unionByName(made.withColumn("kind", F.lit("made"))), ["language", "kind"], "text")
    sizes = pools.groupBy("language").agg(*[F.sum((F.col("kind") == k).cast("long")).alias(k) for k in ("seed", "made")])
    rows = asked.join(sizes.withColumnRenamed("seed", "n_seed").withColumnRenamed("made", "n_made"), "language")
    enough = F.col("n_made") >= synthetic

    def draw(kind: str, m: int, label: str) -> Column:
        return F.transform(drawn(m, F.col(f"n_{kind}"), F.lit(seed), F.lit(label), F.col("prompt_id")), lambda i: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), i.alias("row_id")))

    rest = F.when(enough, draw("made", synthetic, "made")).otherwise(draw("seed", synthetic, "more"))
    picked = rows.select("prompt_id", "language", F.explode(F.concat(draw("seed", n - synthetic, "seed"), rest)).alias("d")).select("prompt_id", "language", "d.*")
    found = picked.join(pools, ["language", "kind", "row_id"]).withColumn("turn", F.md5(F.concat_ws("|", F.lit(str(seed)), "prompt_id", "label", "row_id")))
    return found.groupBy("prompt_id", "language").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("examples"))


def list_prompt(language: Column, examples: Column, n: int = 20) -> Column:
    """Asks for a list of n passages that goes on after numbered examples; passages stand between lines of '##'."""
    shown = F.array_join(F.transform(examples, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), f"\n\n{SEPARATOR}\n\n")
    return F.concat(
        F.lit("Go on with this list of "), F.lit(str(n)), F.lit(" passages in "), language,
        F.lit(", each of one to three correct sentences on a topic of its own, without translations or remarks.\n\n"), shown, F.lit(f"\n\n{SEPARATOR}"),
    )


def listed_passages(answer: Column) -> Column:
    """The passages of an answer to list_prompt(), without their numbers and blank ones."""
    parts = F.transform(F.split(answer, SEPARATOR), lambda x: T.strip(F.regexp_replace(T.strip(x), r"^\d+\.\s*", "")))
    return F.filter(parts, lambda x: x != "")


def demonstrations(asked: DataFrame, passages: DataFrame, languages: list[str], n_rows: int, n: int, seed: int = 122) -> DataFrame:
    """prompt_id, examples: n numbered passages, each of another language and another row of aligned passages (language, row_id, text).

    ``n_rows`` is the number of aligned rows, numbered from 0.
    """
    at = drawn(n, F.lit(len(languages)).cast("long"), F.lit(seed), F.lit("language"), F.col("prompt_id"))
    rows = drawn(n, F.lit(n_rows).cast("long"), F.lit(seed), F.lit("row"), F.col("prompt_id"))
    names = F.array(*[F.lit(x) for x in languages])
    picked = asked.select("prompt_id", F.posexplode(F.arrays_zip(at.alias("l"), rows.alias("r"))).alias("pos", "z"))
    picked = picked.select("prompt_id", "pos", F.element_at(names, (F.col("z.l") + 1).cast("int")).alias("language"), F.col("z.r").alias("row_id"))
    texts = picked.join(passages.select("language", "row_id", "text"), ["language", "row_id"])
    line = F.concat((F.col("pos") + 1).cast("string"), F.lit(". "), F.col("language"), F.lit(" text\n"), F.col("text"))
    made = texts.groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("e"))
    return made.select("prompt_id", F.array_join(F.col("e")["line"], "\n\n").alias("examples"))


def one_round(asked: DataFrame, seeds: DataFrame, made: DataFrame, n: int, synthetic: int, seed: int, factory: Callable[[], Backend] = EchoBackend, tau: float = 0.7) -> DataFrame:
    """language, text of one round: passages that pass the gates and are unlike the seeds, the made ones and each other."""
    prompts = mixed_examples(asked, seeds, made, n, synthetic, seed).withColumn("prompt", list_prompt(F.col("language"), F.col("examples")))
    answers = generate(prompts, "prompt", factory).select("prompt", F.get("candidates", F.lit(0)).alias("answer"))
    items = prompts.join(answers, "prompt").select("language", F.explode(listed_passages(F.col("answer"))).alias("text"))
    clean = G.repetition_gates(items.withColumn("text", T.flattened(F.col("text"))))
    both = seeds.select("language", "text").unionByName(made.select("language", "text")).withColumn("new", F.lit(0)).unionByName(clean.withColumn("new", F.lit(1)))
    ranked = both.withColumn("doc_id", F.concat(F.col("new").cast("string"), F.md5(F.concat_ws("|", "language", "text")))).groupBy("language", "text").agg(F.min("doc_id").alias("doc_id"), F.min("new").alias("new"))
    ranked = ranked.withColumn("t", T.ascii_tokens(F.col("text")))
    return S.greedy_unlike(ranked, "t", tau, "language").where("new = 1").select("language", "text")


def self_instruct(seeds: DataFrame, wanted: int, n: int, synthetic: int, prompts: int, save: Callable[[DataFrame, int], DataFrame], seed: int = 122, most_empty: int = 50, factory: Callable[[], Backend] = EchoBackend) -> DataFrame:
    """Rounds of ``prompts`` prompts per language until ``wanted`` texts are made or ``most_empty`` rounds in a row bring none.

    ``save`` writes the rows of a round and returns all that is made so far, read back; a restart goes on from there.
    """
    spark = seeds.sparkSession
    made, have, empty, r = save(seeds.select("language", "text").limit(0), -1), 0, 0, 0
    have = made.count()
    while have < wanted and empty < most_empty:
        asked = seeds.select("language").distinct().join(spark.range(prompts).withColumnRenamed("id", "p"), F.lit(True))
        asked = asked.select("language", F.concat_ws("|", F.lit(str(r)), "language", "p").alias("prompt_id"))
        made = save(one_round(asked, seeds, made, n, synthetic, seed + r, factory), r)
        now = made.count()
        empty = empty + 1 if now == have else 0
        have, r = now, r + 1
    return made


def neighbour_rounds(pool: DataFrame, k: int, rounds: int, save: Callable[[DataFrame, int], DataFrame], stops: list[str] | None = None, factory: Callable[[], Backend] = EchoBackend) -> DataFrame:
    """The pool (item_id, text, v) after rounds in which every row gets one more text from a prompt of its k nearest rows and itself, so that it doubles each time.

    Answers are cut at the next number and the stop strings, and their first line stays, even if blank. New rows have ids by md5 of round and row, and
    their own embeddings. ``save`` writes a round's pool and returns it read back.
    """
    for r in range(rounds):
        near = S.dense_top_k(pool.select(F.col("item_id").alias("query_id"), F.col("v").alias("q")), pool.select("item_id", "v"), k, exclude_self=True)
        shots = near.join(pool.select("item_id", "text"), "item_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text")))["text"].alias("near"))
        own = pool.select(F.col("item_id").alias("query_id"), "text").join(shots, "query_id", "left")
        examples = F.concat(F.coalesce("near", F.array().cast("array<string>")), F.array("text"))
        asked = own.select("query_id", PR.neighbour_prompt(examples).alias("prompt"), F.size(examples).alias("n"))
        answers = generate(asked, "prompt", factory).select("prompt", F.get("candidates", F.lit(0)).alias("answer"))
        said = asked.join(answers, "prompt").withColumn("answer", F.get(F.split(T.strip(F.col("answer")), F.concat(F.lit(r"(?m)^"), (F.col("n") + 1).cast("string"), F.lit(r"\. "))), F.lit(0)))
        line = T.strip(F.get(F.split(T.truncate_at(F.col("answer"), stops or T.DEFAULT_STOPS), "\n"), F.lit(0)))
        fresh = said.select(F.xxhash64(F.lit(r), "query_id").alias("item_id"), line.alias("text"))
        grown = embed(fresh, "text", factory).select("item_id", "text", F.col("embedding").cast(pool.schema["v"].dataType).alias("v"))
        pool = save(pool.select("item_id", "text", "v").unionByName(grown), r)
    return pool
