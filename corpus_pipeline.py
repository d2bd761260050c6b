"""A training corpus from documents, in five stages; each is a table of documents for the next, the last one its encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.mixing import mixed_documents
from corpusloom.llm.queries_python import TOXIC_FROM
from corpusloom.llm.sampled_pieces import sample_pieces
from corpusloom.llm.setsketch import keep_one
from corpusloom.llm.store import stage
from corpusloom.llm.suffix_dedup import remove_repeats
from corpusloom.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the model, learned from the labelled ones, finds toxic.

    Null and empty texts stay, and so does everything if no document is labelled toxic; extra columns stay, whatever their names.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels)
    fresh = "score" + "_" * max(len(c) for c in docs.columns)  # no column has this name
    return score_toxicity(docs, model, fresh).where(F.col(fresh) < TOXIC_FROM).drop(fresh)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, 80 % alike.

    Null and empty texts are like nothing and stay; of repeated rows one stays; rows without doc_id stay.
    """
    return keep_one(docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings of 200 that occur again; rows stay, even if nothing of their text is left, and null texts stay null."""
    return remove_repeats(docs, length=200)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; texts without words are never taken, a null source is a source."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, as piece ids; equal rows, of which the mix makes copies, get equal samples."""
    return sample_pieces(docs, k=2, with_ids=True).drop("perturbed")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("source_mix", mix),
    ("sampled_pieces", encode),
]

ORACLE_SQL = None  # a trained model, a sketch and sampled segmentations; tests/llm compares the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is written and read again."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        out = stage(step(spark, out, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, out, sf_dir)
