"""Exact top-k inner-product search by ball trees with branch and bound.

Vectors are dealt into shards of a bounded number of rows. In each shard a ball tree is built (median splits along
the axis of greatest spread); a query visits nodes in the order of their upper bound
``q . centre + |q| * radius`` and stops when the best bound left cannot beat its current k-th score. The k-th score is shared:
every query first searches its home shard, and that score is its starting bound in all others.
Queries go past the other shards' trees as a stream, each tree being built once, so nothing that grows is broadcast or gathered.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or as candidates;
vectors, of any length, are compared only with those of their own length; rows with equal ids are separate candidates, and only the
query's own row is left out; fewer candidates than k give fewer rows; scores are integers, exact up to 64 bits (larger ones stop
at the largest 64-bit number); ties go to the smaller id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.store import frugal, plain, small_batches, stage

LEAF = 48
FOUND = "query_row long, query_id long, row long, vec_id long, score long"


def quantised(embedding: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component as long; null where a component is null or not finite."""
    x = F.transform(embedding, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), F.transform(x, lambda v: F.floor(v * scale)))


class BallTree:
    """Flat ball tree over the rows of an integer matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        limit = np.iinfo(np.int64).max
        top = max((abs(int(vectors.max(initial=0))), abs(int(vectors.min(initial=0)))))
        self.safe = top * top * max(1, vectors.shape[1]) < 2**53
        self.limit = limit
        points = vectors.astype(np.float64)
        order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, np.ndarray, float, int, int, int]] = []
        todo = [(0, len(ids), -1, 0)]
        children: dict[int, list[int]] = {}
        while todo:
            lo, hi, parent, _ = todo.pop()
            part = points[order[lo:hi]]
            centre = part.mean(axis=0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max(initial=0.0)))
            me = len(self.nodes)
            self.nodes.append((lo, hi, centre, radius, int(ids[order[lo:hi]].min()), -1, -1))
            children.setdefault(parent, []).append(me)
            if hi - lo > LEAF and radius > 0:
                axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                mid = (hi - lo) // 2
                order[lo:hi] = order[lo:hi][np.argpartition(part[:, axis], mid)]
                todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 0)]
        self.kids = [children.get(i, []) for i in range(len(self.nodes))]
        self.centres = np.array([n[2] for n in self.nodes])
        self.radii = np.array([n[3] for n in self.nodes])
        self.lows = [n[4] for n in self.nodes]
        self.order, self.ids = order, ids[order]
        self.points, self.exact = points[order], vectors[order]

    def _scores(self, lo: int, hi: int, q: np.ndarray, qf: np.ndarray) -> np.ndarray:
        if self.safe:
            return (self.points[lo:hi] @ qf).astype(np.int64)
        sums = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in self.exact[lo:hi]]
        return np.array([min(max(s, -self.limit - 1), self.limit) for s in sums], dtype=np.int64)

    def search(self, q: np.ndarray, k: int, bound: tuple[int, int] | None, skip: int | None) -> list[tuple[int, int, int]]:
        """The best k (score, id, position) that stand before ``bound`` = (score, id), without position ``skip``."""
        if not len(self.ids):
            return []
        qf = q.astype(np.float64)
        tops = self.centres @ qf + np.sqrt(qf @ qf) * self.radii
        tops = tops + np.abs(tops) * 1e-9 + 1.0
        best: list[tuple[int, int, int]] = []  # heap: worst first, as (score, -id, position)
        heap = [(-tops[0], 0)]
        while heap:
            top, node = heapq.heappop(heap)
            worst = (best[0][0], -best[0][1]) if len(best) == k else None
            if bound is not None and (worst is None or (worst[0], -worst[1]) < (bound[0], -bound[1])):
                worst = bound
            if worst is not None and -top < worst[0]:
                break
            if worst is not None and -top < worst[0] + 1 and self.lows[node] > worst[1]:
                continue
            if self.kids[node]:
                for c in self.kids[node]:
                    heapq.heappush(heap, (-tops[c], c))
                continue
            lo, hi = self.nodes[node][:2]
            scores = self._scores(lo, hi, q, qf)
            ok = np.nonzero(scores >= worst[0])[0] if worst is not None else np.arange(hi - lo)
            if len(ok) > 4 * k:  # a large ball of equal vectors: only its first ids can matter
                ok = ok[np.lexsort((self.ids[lo:hi][ok], -scores[ok]))[: k + 1]]
            for i in ok:
                at = int(self.order[lo + i])
                if at == skip:
                    continue
                item = (int(scores[i]), -int(self.ids[lo + i]), at)
                if bound is not None and item[:2] <= (bound[0], -bound[1]):
                    continue
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(s, -i, p) for s, i, p in sorted(best, reverse=True)]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _answers(found: list[tuple[int, int, int, int, int]]) -> pa.Table:
    names = ["query_row", "query_id", "row", "vec_id", "score"]
    columns = list(zip(*found, strict=True)) if found else [[]] * 5
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _search_home(k: int) -> Callable[[pa.Table], pa.Table]:
    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("row")
        ids, rows, vectors = shard["vec_id"].to_numpy(), shard["row"].to_numpy(), _matrix(shard["v"])
        asks = np.nonzero(shard["is_query"].to_numpy(zero_copy_only=False))[0]
        tree = BallTree(ids, vectors) if len(asks) else None
        return _answers([(rows[a], ids[a], rows[p], i, s) for a in asks for s, i, p in tree.search(vectors[a], k, None, int(a))])

    return run


def _search_away(k: int):
    """Rows sorted by shard, the shard's vectors before the queries: one tree is built per shard, and the queries go past it batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree, rows = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch["dim"].to_pylist(), batch["shard"].to_pylist(), batch["asks"].to_pylist(), strict=True))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in itertools.pairwise(cuts):
                part = pa.Table.from_batches([batch.slice(lo, hi - lo)])
                if keys[lo][:2] != shard:
                    shard, held, tree = keys[lo][:2], [], None
                if not keys[lo][2]:
                    held.append(part)
                    continue
                if tree is None:
                    own = pa.concat_tables(held).sort_by("row") if held else part.slice(0, 0)
                    tree, rows, held = BallTree(own["vec_id"].to_numpy(), _matrix(own["v"])), own["row"].to_numpy(), []
                scores, ids = part["kth_score"].to_pylist(), part["kth_id"].to_pylist()
                out = []
                for n, q in enumerate(_matrix(part["v"])):
                    bound = None if scores[n] is None else (scores[n], ids[n])
                    ask = (part["row"][n].as_py(), part["vec_id"][n].as_py())
                    out += [(*ask, rows[p], i, s) for s, i, p in tree.search(q, k, bound, None)]
                yield from _answers(out).to_batches()

    return run


def top_k_inner_product(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, shard_rows: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query against all other rows.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on these two. Other columns are ignored, whatever their names.
    """
    base = plain(vectors, "vec_id", "embedding").select("vec_id", quantised(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    base = base.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).withColumn("dim", F.size("v"))
    base = stage(base.withColumn("row", F.monotonically_increasing_id()), "ball-vectors")
    sizes = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = vectors.sparkSession
    n_all = max([1, *sizes.values()])
    per_shard = min(max(shard_rows, n_all // 4096), 262_144)
    plan = spark.createDataFrame([(d, -(-n // per_shard)) for d, n in sizes.items()] or [(0, 1)], "dim int, shards int")
    dealt = base.join(F.broadcast(plan), "dim")  # one row per vector length
    shard = F.pmod(F.xxhash64("row"), F.col("shards")).cast("int")
    dealt = dealt.withColumn("shard", shard)
    home = stage(
        dealt.groupBy("dim", "shard").applyInArrow(_search_home(k), FOUND), "ball-home"
    )
    kth = home.groupBy("query_row").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))).alias("best")
    ).select("query_row", (-F.get("best", F.lit(k - 1))["s"]).alias("kth_score"), F.get("best", F.lit(k - 1))["i"].alias("kth_id"))
    queries = (
        dealt.where("is_query")
        .join(kth.withColumnRenamed("query_row", "row"), "row", "left")
        .withColumn("home", F.col("shard"))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .where(F.col("shard") != F.col("home"))
        .select("dim", "shard", F.lit(True).alias("asks"), "row", "vec_id", "v", "kth_score", "kth_id")
    )
    none = F.lit(None).cast("long")
    stock = dealt.select("dim", "shard", F.lit(False).alias("asks"), "row", "vec_id", "v", none.alias("kth_score"), none.alias("kth_id"))
    small_batches(spark)
    met = stock.unionByName(queries).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "asks")
    away = met.mapInArrow(frugal(_search_away(k)), FOUND)
    ranked = home.unionByName(away).withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

