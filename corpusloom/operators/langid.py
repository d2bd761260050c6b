"""Language identification learned from labelled rows: log odds of hashed character trigrams.

Counts of trigrams per language are made where the rows are and summed by Spark; what reaches the driver is one small table, whose size
is checked. A text's language is that with the highest sum over its trigrams. Where less than half of them were ever
seen in that language the text is in none of them: an unknown script or a language without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T

UNKNOWN = "und"
BUCKETS = 1 << 14
BASE = 131
SCALE = 1000  # weights are whole thousandths, so that sums are exact in any order
MOST_LANGUAGES = 1024  # a table of 64 MB
NO_LETTERS = r"[^\p{L}\p{M}]+"


def letters(text: Column) -> Column:
    """Lower-case letters and marks with single blanks between and around them; empty if there are none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NO_LETTERS, " "))
    return F.when(plain == "", "").otherwise(F.concat(F.lit(" "), plain, F.lit(" ")))


def buckets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all trigrams of code points, and the number of the text of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    own = owner[:-2] == owner[2:]
    return (((codes[:-2] * BASE + codes[1:-1]) * BASE + codes[2:]) % size)[own], owner[:-2][own]


@dataclass
class LanguageModel:
    """Languages in order of their names; for each a weight for every bucket, and which buckets it was seen in."""

    languages: list[str]
    weights: np.ndarray
    seen: np.ndarray

    def of_texts(self, texts: list[str]) -> list[str]:
        """The language of every text, which letters() has prepared; ties go to the first in order."""
        out = []
        for lo in range(0, len(texts), 256):
            part = texts[lo : lo + 256]
            at, owner = buckets(part, self.weights.shape[1])
            n = np.bincount(owner, minlength=len(part))
            sums, known = (np.stack([np.bincount(owner, weights=row[at], minlength=len(part)) for row in rows]) for rows in (self.weights, self.seen))
            best = sums.argmax(axis=0)
            sure = (n > 0) & (2 * known[best, np.arange(len(part))] >= n)
            out += [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), sure.tolist(), strict=True)]
        return out

    def language_of(self, text: Column, whole: bool = False) -> Column:
        """The language of the first line that is not blank (or of the whole text); 'und' for null, texts without letters, and languages not learned."""
        if not self.languages:
            return F.lit(UNKNOWN)
        model = self

        @F.pandas_udf("string")
        def named(texts: pd.Series) -> pd.Series:
            return pd.Series(model.of_texts(texts.tolist()), dtype=object)

        line = T.strip(F.coalesce(text, F.lit("")))
        return named(letters(line if whole else F.get(F.split(line, "\n"), F.lit(0))))


def _counter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            texts = batch["text"].to_pylist()
            for name in sorted(set(langs)):
                at, _ = buckets([t for t, x in zip(texts, langs, strict=True) if x == name], size)
                counts[name] = counts.get(name, 0) + np.bincount(at, minlength=size)
        for name, n in counts.items():
            some = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "bucket", "n"])

    return run


def trigram_counts(df: DataFrame, text: str = "text", lang: str = "lang", size: int = BUCKETS) -> DataFrame:
    """lang, bucket, n over whole texts; rows without a language are left out."""
    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), letters(F.col(text)).alias("text"))
    return rows.mapInArrow(_counter(size), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit_languages(df: DataFrame, text: str = "text", lang: str = "lang", size: int = BUCKETS) -> LanguageModel:
    """The model of all labelled rows: weight = round(1000 * ln((n + 1) / (total + buckets))).

    An empty table gives a model that knows no language; over MOST_LANGUAGES labels are an error.
    """
    counts = trigram_counts(df, text, lang, size)
    n = counts.select("lang").distinct().count()
    if n > MOST_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MOST_LANGUAGES} fit the table that goes to every task")
    table = counts.toPandas()  # languages x buckets at most
    languages = sorted(table["lang"].unique())
    full = np.zeros((len(languages), size), np.int64)
    full[np.searchsorted(languages, table["lang"]) if len(table) else [], table["bucket"].to_numpy(np.int64)] = table["n"]
    weights = np.round(SCALE * np.log((full + 1) / (full.sum(axis=1, keepdims=True) + size))).astype(np.int32)
    return LanguageModel(list(languages), weights, full > 0)


def is_held_out(key: Column, seed: str = "lid") -> Column:
    """Three in sixteen rows, by the md5 of (seed, key)."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"))), 1, 1).isin("0", "1", "2")


def held_out_accuracy(df: DataFrame, key: str, text: str = "text", lang: str = "lang", whole: bool = False) -> DataFrame:
    """lang, n, n_right of labelled rows held out from the model."""
    model = fit_languages(df.where(~is_held_out(F.col(key))), text, lang)
    asked = df.where(is_held_out(F.col(key)) & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), model.language_of(F.col(text), whole).alias("found"))
    return asked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("found") == F.col("lang")).cast("long")).alias("n_right"))
