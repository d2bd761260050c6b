import random

from pyspark.sql import functions as F

from corpusloom.llm.ball_search import top_k_inner_product


def brute(rows, k):
    import math

    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for n, (i, v) in enumerate(good):
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(good) if m != n and len(w) == len(v))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def rows(seed=2, n=700):
    rng = random.Random(seed)
    out = [(i, [float("%.3f" % rng.gauss(0, 1)) for _ in range(8)]) for i in range(n)]
    out[50] = (50, None)
    out[51] = (51, [1.0, None] + [0.0] * 6)
    out[52] = (52, [float("nan")] + [0.0] * 7)
    out[53] = (53, [float("inf")] + [0.0] * 7)
    out[54] = (54, [1.0, 2.0])
    for i in range(300, 360):
        out[i] = (i, out[300][1])  # many equal vectors: ties go to the smaller id
    return out


def run(spark, data, k=10, **more):
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    from_frame = [(r.vec_id, r.embedding) for r in df.collect()]
    got = top_k_inner_product(df, F.col("vec_id") % 100 == 0, k, **more).collect()
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in got}, brute(from_frame, k), len(got)


def test_matches_brute_force(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # a shard and its queries come in many batches
    try:
        got, want, n = run(spark, rows(), shard_rows=97)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and n == len(want)


def test_few_candidates_and_large_numbers(spark):
    got, want, _ = run(spark, [(0, [1e6, 3.0]), (100, [2.0, 1e7]), (1, [0.0, 0.0]), (2, [])])
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k_inner_product(df, F.lit(True)).count() == 0


def test_names_that_clash_ties_and_repeated_rows(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [0.5, 0.5, 9.0])]
    odd = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as dim", "3 as shard", "4 as `row`", "5 as asks", "6 as `a.b`", "7 as VEC_ID", "8 as Embedding")
    got = top_k_inner_product(odd, F.col("vec_id") % 100 == 0, k=3)
    want = [(100, 1, 2, 1024 * 1024), (100, 2, 3, 1024 * 1024), (100, 3, 100, 1024 * 1024)]
    assert sorted(map(tuple, got.collect())) == sorted(want * 2)  # each of the two equal rows asks, and finds the other
