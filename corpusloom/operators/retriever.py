"""One way to ask for demonstrations: retrievers by name, each for a whole table of queries at once."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as T
from corpusloom.functions.stemming import stemmer
from corpusloom.operators import similarity as S
from corpusloom.operators.inference import Backend, EchoBackend, embed

# English words that an index leaves out.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def word_runs(text: Column) -> Column:
    """Lower-case runs of two letters, digits and underscores or more, without English stop words; none in a null text."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.filter(runs, lambda x: ~x.isin(STOP_WORDS))


def index_tokens(text: Column) -> Column:
    """Lower-case words between blanks; none in a null text."""
    return T.words(F.lower(F.coalesce(text, F.lit(""))))


def structural_top_k(parts: DataFrame, pool: DataFrame, k: int, n_parts: int, find: Callable[[DataFrame, DataFrame, int], DataFrame] = S.bm25_top_k, said: str = "tokens") -> DataFrame:
    """query_id, item_id, pos: items found by BM25 for each part of a query, dealt in turn, each once; the k last in order of likeness (pos k is the best).

    ``parts`` has query_id, part and, as ``find`` wants it of queries and pool, tokens or another column; every part asks for 2 * ceil(k / n_parts) items.
    """
    keyed = parts.select(F.xxhash64("query_id", "part").alias("query_id"), F.col("query_id").alias("whole"), "part", said)
    found = find(keyed.select("query_id", said), pool, 2 * math.ceil(k / n_parts))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("pos"))
    ranked = found.withColumn("rank", F.row_number().over(best_first)).join(keyed.select("query_id", "whole", "part"), "query_id")
    once = ranked.groupBy(F.col("whole").alias("query_id"), "item_id").agg(F.min(F.struct("rank", "part")).alias("b"))
    turn = Window.partitionBy("query_id").orderBy("b.rank", "b.part", "item_id")
    dealt = once.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= k)
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return dealt.withColumn("pos", (n - F.col("r") + 1).cast("long")).select("query_id", "item_id", "pos")


class Retriever:
    """Demonstrations from a pool of (item_id, text) by a kind of likeness, named by what its name contains.

    'structural' together with 'bm25s' (parts of a query are looked up one by one), 'bm25s', 'rank_bm25', 'random', 'lcs' or 'subsequence', 'histogram' (labels of words), and
    anything else by embeddings; with a ``language``, 'bm25s' compares stems of word runs. query() takes (query_id, text), or (query_id, part, text) for 'structural', and returns query_id, item_id, pos
    with the most similar last.
    """

    def __init__(self, kind: str, pool: DataFrame, seed: int = 122, factory: Callable[[], Backend] = EchoBackend, label: Callable[[Column], Column] | None = None, language: str | None = None):
        if "structural" in kind and "bm25s" not in kind:
            raise ValueError("structural retrieval needs bm25s")
        self.kind, self.pool, self.seed, self.factory = kind, pool, seed, factory
        self.label = label or (lambda w: F.substring(w, 1, 1))
        self.stem = stemmer(language) if language else None

    def query(self, queries: DataFrame, k: int) -> DataFrame:
        q, p = queries, self.pool
        tokens = lambda df, name: df.select(name, index_tokens(F.col("text")).alias("tokens"))
        if "structural" in self.kind:
            n_parts = q.agg(F.max("part")).first()[0] or 1
            if self.stem:
                return structural_top_k(q.select("query_id", "part", "text"), p.select("item_id", "text"), k, n_parts, self._by_stems, "text")
            return structural_top_k(q.select("query_id", "part", index_tokens(F.col("text")).alias("tokens")), tokens(p, "item_id"), k, n_parts)
        if "bm25s" in self.kind and self.stem:
            found = self._by_stems(q, p, k)
        elif "bm25s" in self.kind:
            found = S.bm25_top_k(tokens(q, "query_id"), tokens(p, "item_id"), k)
        elif "rank_bm25" in self.kind:
            found = S.bm25_top_k(tokens(q, "query_id"), tokens(p, "item_id"), k, b=0.75, okapi=True)
        elif "random" in self.kind:
            found = S.random_k(q, p, k, self.seed)
        elif "lcs" in self.kind or "subsequence" in self.kind:
            found = S.lcs_top_k(tokens(q, "query_id"), tokens(p, "item_id"), k)
        elif "histogram" in self.kind:
            found = S.histogram_kernel(self._labels(q, "query_id"), self._labels(p, "item_id"), k)
        else:
            v, w = embed(q.select("query_id", "text"), "text", self.factory), embed(p.select("item_id", "text"), "text", self.factory)
            found = S.dense_top_k(v.select("query_id", F.col("embedding").alias("q")), w.select("item_id", F.col("embedding").alias("v")), k)
        return found.select("query_id", "item_id", F.col("pos").cast("long").alias("pos"))

    def _by_stems(self, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
        return S.bm25_stems_top_k(queries, pool, word_runs, self.stem, k)

    def _labels(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(name, F.explode(T.words(F.col("text"))).alias("w")).select(name, self.label(F.col("w")).alias("label"))
