"""Queries of the operators that run Python on Arrow batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.ball_search import top_k_inner_product
from corpusloom.llm.lm_scores import score_texts
from corpusloom.llm.sampled_pieces import sample_pieces
from corpusloom.llm.setsketch import near_duplicates
from corpusloom.llm.suffix_dedup import repeated_spans
from corpusloom.llm.token_counts import count_tokens
from corpusloom.llm.toxicity import fit_toxicity, score_toxicity


def held_out(modulus: int) -> Column:
    """Whether the row is kept from learning: crc32 of the id's text leaves 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 2, F.lit(False))


def op1_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: three-word shingles, 85 % alike."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned from those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_texts(docs, ~held_out(7)).withColumn("held_out", held_out(7))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of pieces of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))


TOXIC_FROM = 0.3


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels of those not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels.where(~held_out(4)))
    scored = score_toxicity(docs, model, "score")
    return scored.select(
        "doc_id",
        held_out(4).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 200 that occur again."""
    spans = repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=200)
    return spans.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k_inner_product(vectors, F.col("vec_id") % 100 == 0, k=10)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

def op10_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document."""
    return sample_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2).drop("perturbed")


QUERIES = {"op10_sampled_pieces": op10_sampled_pieces, "op1_setsketch_dedup": op1_setsketch_dedup, "op2_ball_search": op2_ball_search, "op4_lm_scores": op4_lm_scores, "op5_token_counts": op5_token_counts, "op6_toxicity": op6_toxicity, "op7_suffix_dedup": op7_suffix_dedup}
ORACLES = {"op2_ball_search": OP2_SQL}
