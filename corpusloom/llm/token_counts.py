"""Token counts by a count-only Viterbi search.

Aho-Corasick enumerates the vocabulary's matches; the dynamic programme carries the best score and the number of pieces, never
the pieces. Ties go to the longest last piece, unknown characters cost the lowest score less 10 and count one piece per byte (byte
fallback). Each distinct unit of a batch is searched once.

Defined results: null and empty texts have 0 tokens and score 0; repeated rows are counted alike; among segmentations of equal score that with the
longest last piece counts; texts of any length are counted whole; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.lattice import DEFAULT_MODEL, Lattice, Vocabulary, split_units
from corpusloom.llm.store import frugal, plain, small_batches

CACHE_UNITS = 400_000


def _counter(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = vocabulary.automaton()
        known: dict[str, int] = {}  # unit -> number in the two lists
        scores, counts = np.zeros(0), np.zeros(0, np.int64)
        for batch in batches:
            tokens, totals, n_units = [], [], []
            texts = [t or "" for t in batch["text"].to_pylist()]
            for lo in range(0, len(texts), 256):
                split = [split_units(t) for t in texts[lo : lo + 256]]
                fresh = list(set().union(*map(set, split)) - known.keys())
                if len(known) + len(fresh) > CACHE_UNITS:  # memory stays bounded; units are simply searched again
                    known.clear()
                    scores, counts = scores[:0], counts[:0]
                    fresh = list(set().union(*map(set, split)))
                if fresh:
                    s, c = Lattice.build(fresh, vocabulary, automaton).viterbi()
                    known.update(zip(fresh, range(len(scores), len(scores) + len(fresh)), strict=True))
                    scores, counts = np.append(scores, s), np.append(counts, c)
                for u in split:
                    at = np.fromiter(map(known.__getitem__, u), np.int64, len(u))
                    tokens.append(int(counts[at].sum()))
                    totals.append(float(scores[at].sum()))
                    n_units.append(len(u))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(n_units, pa.int64()), pa.array(tokens, pa.int64()), pa.array(totals, pa.float64())],
                names=["doc_id", "n_units", "n_tokens", "best_score"],
            )

    return run


def count_tokens(docs: DataFrame, model_path: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_units, n_tokens, best_score of every row; the vocabulary (of fixed size) goes along with the tasks."""
    vocabulary = Vocabulary.load(model_path)
    small_batches(docs.sparkSession)
    return plain(docs, "doc_id", "text").mapInArrow(frugal(_counter(vocabulary)), "doc_id long, n_units long, n_tokens long, best_score double")
