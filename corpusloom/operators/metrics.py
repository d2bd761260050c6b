"""Corpus metrics: BLEU on words, chrF++, resampling, paired tests, diversity, best-of-N."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import let, words


def gram_counts(df: DataFrame, keys: list[str], side: str, tokens: Column, orders: range, kind: str = "w") -> DataFrame:
    """keys, kind, order, gram, and how often it occurs on one side."""
    none = F.array().cast("array<struct<n:int,g:string>>")

    def all_orders(t: Column) -> Column:
        return F.flatten(F.array(*[F.when(F.size(t) >= n, _grams(t, n)).otherwise(none) for n in orders]))

    grams = let(tokens, all_orders)  # the tokens are made once per row, not once per gram
    rows = df.select(*keys, F.explode(grams).alias("x")).select(*keys, F.lit(kind).alias("kind"), F.col("x.n").alias("n"), F.xxhash64("x.g").alias("g"))
    return rows.groupBy(*keys, "kind", "n", "g").agg(F.count(F.lit(1)).alias(side))


def _grams(tokens: Column, n: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(tokens, i, n), "\x01").alias("g"))
    )


CLIP_TOKENS = 200_000  # of both sides, counted at a time
_PLACES = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _gram_keys(values: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of (row, n-gram) of token lists laid end to end."""
    rows = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
    m = max(0, len(values) - n + 1)
    grams = rows[:m] * np.uint64(0x8EBC6AF09C88C6E3)
    for k in range(n):
        grams = (grams ^ (grams >> np.uint64(29))) * _PLACES[1] + values[k : k + m] * _PLACES[k]
    return grams[rows[:m] == rows[n - 1 :]] if m else grams


def _clip(df: DataFrame, hyp: Column, ref: Column, orders: range, kind: str) -> DataFrame:
    """kind, n, and the sums of hypothesis grams, reference grams and clipped matches.

    Both sides of a pair stand in one row, so its grams are counted there, many rows at a time in Arrow batches; a few sums per batch are all that moves.
    ``hyp`` and ``ref`` are token arrays, or texts of which the characters that are no blanks are the tokens.
    """
    rows = df.select(F.coalesce(hyp, F.array().cast("array<string>")).alias("h"), F.coalesce(ref, F.array().cast("array<string>")).alias("r")) if kind == "w" else df.select(F.coalesce(hyp, F.lit("")).alias("h"), F.coalesce(ref, F.lit("")).alias("r"))
    if kind == "w":
        rows = rows.select(*[F.transform(c, lambda x: F.xxhash64(x)).alias(c) for c in ("h", "r")])

    def side(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if kind == "w":
            return np.asarray(column.flatten()).view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        points = [np.frombuffer(t.encode("utf-32-le"), "<u4") for t in column.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint64), *points]).astype(np.uint64) + np.uint64(1), np.concatenate([[0], np.cumsum([len(x) for x in points])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(orders), 3), np.int64)
        for batch in batches:
            lengths = [pc.list_value_length(batch[c]) if kind == "w" else pc.utf8_length(batch[c]) for c in ("h", "r")]
            upto = np.cumsum(lengths[0].to_numpy() + lengths[1].to_numpy().astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CLIP_TOKENS, "right")))
                h, r = (side(batch[c].slice(lo, hi - lo)) for c in ("h", "r"))
                for i, n in enumerate(orders):
                    (x, cx), (y, cy) = (np.unique(_gram_keys(*s, n), return_counts=True) for s in (h, r))
                    _, at, of = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                    sums[i] += [cx.sum(), cy.sum(), np.minimum(cx[at], cy[of]).sum()]
                lo = hi
        yield pa.RecordBatch.from_arrays([pa.array(list(orders), pa.int32()), *(pa.array(sums[:, j]) for j in range(3))], names=["n", "h", "r", "m"])

    done = rows.mapInArrow(run, "n int, h long, r long, m long").groupBy("n").agg(F.sum("h").alias("hyp"), F.sum("r").alias("ref"), F.sum("m").alias("match"))
    return done.where("hyp > 0 or ref > 0").select(F.lit(kind).alias("kind"), "n", "hyp", "ref", "match")


def corpus_bleu(df: DataFrame, id_column: str, hyp: str, ref: str, most: int = 4) -> DataFrame:
    """One row: bleu (0 to 100) of word n-grams with brevity penalty; 0 if an order has no match."""
    counts = _clip(df, words(F.col(hyp)), words(F.col(ref)), range(1, most + 1), "w")
    wide = counts.agg(
        F.sum(F.when(F.col("match") > 0, F.log(F.col("match") / F.col("hyp"))).otherwise(float("-inf"))).alias("logs"),
        F.count(F.lit(1)).alias("orders"),
        F.max(F.when(F.col("n") == 1, F.col("hyp"))).alias("h"),
        F.max(F.when(F.col("n") == 1, F.col("ref"))).alias("r"),
    )
    penalty = F.when(F.col("h") >= F.col("r"), 0.0).otherwise(1 - F.col("r") / F.col("h"))
    return wide.select(F.when((F.col("orders") < most) | F.col("h").isNull(), 0.0).otherwise(100 * F.exp(F.col("logs") / most + penalty)).alias("bleu"))


def corpus_chrf(df: DataFrame, id_column: str, hyp: str, ref: str, characters: int = 6, word_order: int = 2, beta: float = 2.0) -> DataFrame:
    """One row: chrf (0 to 100), the mean F-beta over character and word orders that occur."""

    def letters(c: str) -> Column:
        return F.regexp_replace(F.col(c), r"[ \t\n\x0B\f\r]+", "")

    chars = _clip(df, letters(hyp), letters(ref), range(1, characters + 1), "c")
    word = _clip(df, words(F.col(hyp)), words(F.col(ref)), range(1, word_order + 1), "w")
    b2 = beta * beta
    p, r = F.col("match") / F.col("hyp"), F.col("match") / F.col("ref")
    f = F.when((F.col("hyp") == 0) | (F.col("ref") == 0) | (F.col("match") == 0), 0.0).otherwise((1 + b2) * p * r / (b2 * p + r))
    return chars.unionByName(word).where("hyp > 0 or ref > 0").select(f.alias("f")).agg((100 * F.avg("f")).alias("chrf"))


def bootstrap_means(df: DataFrame, row: str, value: str, resamples: int, size: int, seed: int) -> DataFrame:
    """resample, mean over ``size`` rows drawn with replacement; the draws are md5 numbers of (seed, resample, draw).

    ``df`` has rows numbered 0 to n - 1 in ``row``; draws join rows by number, and nothing is gathered.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"))
    draws = df.sparkSession.range(resamples * size).select(F.floor(F.col("id") / size).alias("resample"), (F.col("id") % size).alias("draw")).crossJoin(n)
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "resample", "draw")), 1, 8), 16, 10).cast("long") % F.col("n")
    return draws.withColumn(row, number).join(df.select(row, value), row).groupBy("resample").agg(F.avg(value).alias("mean"))


def paired_t(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, n, mean_diff, t of the paired differences; t is null without spread."""
    d = F.col(a) - F.col(b)
    out = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_s"))
    return out.withColumn("t", F.col("mean_diff") / F.nullif(F.col("_s") / F.sqrt("n"), F.lit(0.0))).drop("_s")


def t_p_value(t: float, degrees: int, alternative: str = "two-sided") -> float:
    """Probability of a t value at least as extreme, by the continued fraction of the incomplete beta function."""
    x = degrees / (degrees + t * t)
    tail = 0.5 * _incomplete_beta(degrees / 2, 0.5, x)
    upper = tail if t > 0 else 1 - tail
    return {"two-sided": min(1.0, 2 * tail), "greater": upper, "less": 1 - upper}[alternative]


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * out


def vendi(df: DataFrame, vector: str) -> float:
    """exp of the entropy of the eigenvalues of the normalised cosine kernel.

    The kernel's spectrum is that of the d x d second-moment matrix of the unit vectors, which is summed in Arrow batches; only d x d numbers reach the driver.
    """
    def moments(batches):
        for batch in batches:
            x = np.array(batch[vector].to_pylist(), np.float64)
            if len(x):
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
                m = x.T @ x
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.size)), pa.array(m.ravel()), pa.array(np.full(m.size, len(x)))], names=["i", "m", "n"])

    rows = df.select(vector).mapInArrow(moments, "i long, m double, n long").groupBy("i").agg(F.sum("m").alias("m"), F.sum("n").alias("n")).collect()
    if not rows:
        return 0.0
    d = math.isqrt(len(rows))
    m = np.zeros(d * d)
    for r in rows:
        m[r["i"]] = r["m"] / r["n"]
    values = np.linalg.eigvalsh(m.reshape(d, d))
    values = values[values > 1e-12]
    return float(np.exp(-(values * np.log(values)).sum()))


def best_candidate(df: DataFrame, group: str, score: Column, pos: str, text: str) -> DataFrame:
    """The candidate with the highest score per group, the earliest of several; blank candidates only if all are blank (then '')."""
    blank = F.trim(F.col(text)) == ""
    rows = df.withColumn("_k", F.struct((~blank).alias("ok"), F.coalesce(score, F.lit(float("-inf"))).alias("s"), (-F.col(pos)).alias("p")))
    best = rows.groupBy(group).agg(F.max("_k").alias("k"), F.max_by(F.struct(text, pos), "_k").alias("b"))
    return best.select(group, F.when(F.col("k.ok"), F.col(f"b.{text}")).otherwise("").alias(text), F.col(f"b.{pos}").alias(pos))


def mutual_scores(df: DataFrame, group: str, pos: str, text: str, most: int = 4) -> DataFrame:
    """group, pos, score: the summed sentence BLEU (0 to 100) of the others of the group against each candidate (groups are small by construction).

    An order without a match counts as half, then a quarter and so on of a match; without any match, or with a hypothesis shorter than ``most`` words, BLEU is 0.
    """
    kept = df.select(F.col(group).alias("_group"), pos, F.coalesce(text, F.lit("")).alias("_t"))
    grams = gram_counts(kept, ["_group", pos], "c", words(F.col("_t")), range(1, most + 1))
    h = grams.select("_group", F.col(pos).alias("j"), "n", "g", F.col("c").alias("h"))
    r = grams.select("_group", F.col(pos).alias("i"), "n", "g", F.col("c").alias("r"))
    orders = [F.sum(F.when(F.col("n") == n, F.least("h", "r")).otherwise(0)).alias(f"m{n}") for n in range(1, most + 1)]
    met = h.join(r, ["_group", "n", "g"]).where("i <> j").groupBy("_group", "i", "j").agg(*orders)
    sizes = kept.select("_group", pos, F.size(words(F.col("_t"))).alias("size"))
    pairs = sizes.toDF("_group", "i", "ref").join(sizes.toDF("_group", "j", "hyp"), "_group").where("i <> j").join(met, ["_group", "i", "j"], "left")
    logs, missed = F.lit(0.0), F.lit(0)
    for n in range(1, most + 1):
        m = F.coalesce(f"m{n}", F.lit(0))
        missed = missed + (m == 0).cast("int")
        logs = logs + F.log(F.when(m == 0, F.pow(F.lit(0.5), missed)).otherwise(m) / (F.col("hyp") - (n - 1)))
    penalty = F.when(F.col("hyp") >= F.col("ref"), 0.0).otherwise(1 - F.col("ref") / F.col("hyp"))
    bleu = F.when((F.col("hyp") < most) | (F.coalesce("m1", F.lit(0)) == 0), 0.0).otherwise(100 * F.exp(logs / most + penalty))
    return pairs.groupBy(F.col("_group").alias(group), F.col("i").alias(pos)).agg(F.round(F.sum(bleu), 6).alias("score"))
