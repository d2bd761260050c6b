import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import selection as SEL
from corpusloom.operators.numbering import percentile, running


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_places_and_totals_over_many_tasks(spark, many_parts):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 3, 10, None]), "x" * (i % 3)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, n int, `a.b` string").withColumnRenamed("a.b", "part")
    got = running(df, ["i"], F.col("n")).orderBy("i").collect()
    sizes = [n or 0 for _, n, _ in sorted(rows)]
    assert [r.number for r in got] == list(range(500)) and [r.before for r in got] == [sum(sizes[:k]) for k in range(500)]
    assert [r.part for r in got] == [p for _, _, p in sorted(rows)]
    assert running(df.where("false"), ["i"]).count() == 0


def test_plans_have_no_window_without_a_key(spark):
    from corpusloom.operators import packing, similarity
    from corpusloom.sources import corpora

    ids = spark.range(30).toDF("item_id")
    made = [
        similarity.random_k(ids.withColumnRenamed("item_id", "query_id"), ids, 2, 1),
        corpora.buffered_shuffle(ids, "item_id", 7, 1),
        corpora.contexts(ids.withColumn("t", (F.col("item_id") / 4).cast("int").cast("string")), "item_id", "t"),
        packing.packed(ids.withColumn("t", F.array(F.col("item_id"))), "item_id", "t", 4),
    ]
    for df in made:
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not any("Sort [" in a and "SinglePartition" in b for a, b in zip(plan, plan[1:], strict=False))  # a count may meet in one task, sorted rows may not


@pytest.mark.parametrize("kind", ["whole", "spread", "few", "one"])
def test_percentiles_are_exact(spark, kind):
    rng = np.random.default_rng(2)
    values = {"whole": rng.integers(0, 50, 3000), "spread": np.exp(rng.normal(0, 30, 3000)) * rng.choice([-1, 1], 3000), "few": np.array([3.0, 1.0, 2.0]), "one": np.full(2000, 7.0)}[kind].astype(float)
    rows = [(float(x),) for x in values] + [(None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "x double")
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert percentile(df, "x", p) == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)
    if kind == "whole":
        got = SEL.above_percentile(df.where("not isnan(x)"), "x", 90)
        assert got.count() == int((values > np.percentile(values, 90)).sum())


def test_percentile_of_nothing_and_of_infinity(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert percentile(df, "x", 0.5) is None and SEL.above_percentile(df, "x", 50).count() == 0
    wide = spark.createDataFrame([(float("inf"),), (1.0,), (float("-inf"),)], "x double")
    assert percentile(wide, "x", 0.5) == 1.0
