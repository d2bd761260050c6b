"""Model steps as operators: prompts in, generations, embeddings or scores out, by pluggable backends.

A backend is made once per Python worker by a factory, called with lists, and never sees Spark. Each prompt is sent once: results are keyed by the prompt's hash,
rows that are done already are left out, and a failed call is retried in place.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.numbering import use_shared_checkpoints


@dataclass(frozen=True)
class Sampling:
    """Settings of a generation."""

    max_new_tokens: int = 256
    temperature: float = 0.0
    top_p: float = 1.0
    repetition_penalty: float = 1.0
    num_return_sequences: int = 1
    num_beams: int = 1
    batch_size: int = 16
    retries: int = 3


class Backend(Protocol):
    def generate(self, prompts: list[str], sampling: Sampling) -> list[list[str]]: ...
    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def score(self, sources: list[str], candidates: list[str], references: list[str | None]) -> list[float]: ...


class EchoBackend:
    """A deterministic offline backend: repeats the last line of the prompt, hashes texts to vectors, scores by shared characters."""

    def generate(self, prompts: list[str], sampling: Sampling) -> list[list[str]]:
        return [[p.rstrip().rsplit("\n", 1)[-1] if p else ""] * sampling.num_return_sequences for p in prompts]

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * 16
            for a, b in zip(t, t[1:], strict=False):
                v[(ord(a) * 31 + ord(b)) % 16] += 1.0
            out.append(v)
        return out

    def score(self, sources: list[str], candidates: list[str], references: list[str | None]) -> list[float]:
        return [2 * len(set(a) & set(b)) / max(1, len(set(a)) + len(set(b))) for a, b in zip(candidates, sources, strict=True)]


def _retried(call: Callable[[], list], retries: int) -> list:
    for attempt in range(retries):
        try:
            return call()
        except Exception:  # a backend may raise anything
            if attempt + 1 == retries:
                raise
            time.sleep(0.1 * 2**attempt)
    return []


def generate(df: DataFrame, prompt: str, factory: Callable[[], Backend] = EchoBackend, sampling: Sampling = Sampling(), done: DataFrame | None = None) -> DataFrame:
    """Distinct prompts with prompt_hash and candidates array<string>; those in ``done`` (prompt_hash) are not sent again."""
    asked = df.select(F.col(prompt).alias("prompt")).distinct().withColumn("prompt_hash", F.sha2("prompt", 256))
    if done is not None:
        asked = asked.join(done.select("prompt_hash").distinct(), "prompt_hash", "left_anti")
    asked = asked.select("prompt", "prompt_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for batch in batches:
            for lo in range(0, batch.num_rows, sampling.batch_size):
                part = batch.slice(lo, sampling.batch_size)
                prompts = part["prompt"].to_pylist()
                answers = _retried(lambda prompts=prompts: backend.generate(prompts, sampling), sampling.retries)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.list_(pa.string()))], names=["prompt", "prompt_hash", "candidates"])

    return asked.mapInArrow(run, "prompt string, prompt_hash string, candidates array<string>")


def generate_resumable(
    df: DataFrame, prompt: str, ledger: str, factory: Callable[[], Backend] = EchoBackend, sampling: Sampling = Sampling(), wave: int = 100_000, passes: int = 2
) -> DataFrame:
    """prompt, candidates array<string>, error: distinct prompts with the answers of a ledger, which grows until all are answered.

    ``ledger`` is a folder that driver and executors share; its rows are keyed by the hash of prompt and settings, so a run that stops, or another one with
    the same prompts, asks only for what it lacks. Requests go out in waves of about ``wave``, each committed to the ledger before the next one: a lost
    executor repeats its tasks of one wave. A batch that fails in spite of its retries costs no other batch: its rows say why and are asked again
    in the next pass; what is still without an answer after ``passes`` keeps null candidates and its last error. Null prompts are not asked. A request that was answered
    twice, by a task that ran twice, has the smaller answer.
    """
    spark = df.sparkSession
    use_shared_checkpoints(spark)
    key = F.sha2(F.concat(F.lit(f"{sampling}\n"), F.col("prompt")), 256)
    asked = df.select(F.col(prompt).alias("prompt")).where(F.col("prompt").isNotNull()).distinct().withColumn("request", key).checkpoint()
    kinds = "request string, candidates array<string>, error string, tried long"
    spark.createDataFrame([], kinds).write.mode("append").parquet(ledger)
    known = lambda: spark.read.schema(kinds).parquet(ledger)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for batch in batches:
            for lo in range(0, batch.num_rows, sampling.batch_size):
                part = batch.slice(lo, sampling.batch_size)
                prompts, error = part["prompt"].to_pylist(), None
                try:
                    answers = _retried(lambda prompts=prompts: backend.generate(prompts, sampling), sampling.retries)
                except Exception as e:  # a backend may raise anything; the ledger says what
                    answers, error = [None] * len(prompts), f"{type(e).__name__}: {e}"
                columns = [part["request"], pa.array(answers, pa.list_(pa.string())), pa.array([error] * len(prompts), pa.string()), pa.array([time.time_ns()] * len(prompts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["request", "candidates", "error", "tried"])

    for _ in range(passes):
        open_ = asked.join(known().where("candidates IS NOT NULL"), "request", "left_anti")
        n = open_.count()
        if not n:
            break
        waves = -(-n // wave)
        for w in range(waves):
            mine = open_.where(F.pmod(F.xxhash64("request"), F.lit(waves)) == w).select("request", "prompt")
            mine.mapInArrow(run, kinds).write.mode("append").parquet(ledger)
    told = known().groupBy("request").agg(F.min("candidates").alias("candidates"), F.max(F.struct("tried", "error")).alias("last"))
    error = F.when(F.col("candidates").isNull(), F.col("last.error")).alias("error")
    return asked.join(told, "request", "left").select("prompt", "candidates", error)


def embed(df: DataFrame, text: str, factory: Callable[[], Backend] = EchoBackend) -> DataFrame:
    """Add embedding array<float>."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for batch in batches:
            vectors = backend.embed([t or "" for t in batch[text].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*batch.schema.names, "embedding"])

    return df.mapInArrow(run, f"{kinds}, embedding array<float>")


def score(df: DataFrame, source: str, candidate: str, reference: str | None = None, factory: Callable[[], Backend] = EchoBackend) -> DataFrame:
    """Add score double; null where the candidate is null."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for batch in batches:
            c = batch[candidate].to_pylist()
            refs = batch[reference].to_pylist() if reference else [None] * len(c)
            values = backend.score([t or "" for t in batch[source].to_pylist()], [t or "" for t in c], refs)
            values = [None if t is None else float(v) for t, v in zip(c, values, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    return df.mapInArrow(run, f"{kinds}, score double")
