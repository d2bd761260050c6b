from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.suffix_dedup import repeated_spans
from tests.llm.helpers import frame
from tests.llm.test_models import toxic_rows
from tests.llm.test_near_duplicates import brute


def test_stages_on_a_small_corpus(spark, tmp_path):
    rows, labels = toxic_rows(7, 300)
    rows = [(i, t, f"s{i % 4}") for i, t in rows]
    rows += [(400, rows[1][1], "s1"), (401, rows[2][1] + " more", "s2"), (402, None, "s0")]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "source_mix", "sampled_pieces"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    after = []
    for i, (name, step) in enumerate(pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after.append(docs)
        assert docs.columns == columns or i == 4
    toxic = {i for i, t in labels if t}
    left = {r.doc_id for r in after[0].collect()}
    assert len(left & toxic) <= 2 and len(left) >= 238
    want = {i for i, (_, c) in brute([(r.doc_id, r.text) for r in after[0].collect()], 5, 80).items() if i == c}
    assert {r.doc_id for r in after[1].collect()} == want
    assert after[2].count() == len(want) and all(r.n_removed == 0 for r in repeated_spans(after[2]).collect())
    copies = {r.doc_id: r.copies for r in mix_sources(after[2]).collect() if r.copies}
    assert Counter(r.doc_id for r in after[3].collect()) == copies
    assert Counter(r.doc_id for r in after[4].where("sample = 1").collect()) == copies
    assert all(r.decoded for r in after[4].collect())
    assert pipeline.run(spark, str(tmp_path)).count() == after[4].count()


def test_what_op6_calls_toxic_leaves_the_corpus(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(pipeline, "fit_toxicity", lambda docs, labels: None)
    monkeypatch.setattr(pipeline, "score_toxicity", lambda docs, model, name: docs.withColumn(name, F.col("doc_id") / 10))
    assert [r.doc_id for r in pipeline.drop_toxic(spark, spark.range(8).toDF("doc_id"), str(tmp_path)).orderBy("doc_id").collect()] == [0, 1, 2]


def test_stages_take_hard_rows_and_odd_columns(spark, tmp_path):
    rows, labels = toxic_rows(8, 60)
    hard = [(i, t, None if i % 3 else f"s{i % 2}") for i, t in rows]
    hard += [(700, None, "a"), (701, "", None), (702, " \n", "a"), (None, "words without an id here", "b"), (None, None, None), (3, rows[3][1], "s0"), (703, "x " * 30_000, "long")]
    odd = frame(spark, hard).selectExpr("*", "1 as score", "2 as `a.b`", "3 as node", "4 as mark", "5 as size", "6 as sample", "7 as whole_row", "8 as c1")
    odd.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [*labels, (None, 1), (5, None), (2, 0), (2, None)]
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, counts = docs.columns, []
    for i, (_, step) in enumerate(pipeline.STAGES):
        step(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
        assert docs.columns == columns or i == 4
    after = [spark.read.parquet(f"{tmp_path}/{i}") for i in range(5)]
    assert after[0].where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "")) == "").count() == 4  # null and empty texts are not toxic
    assert after[1].where("doc_id = 3").count() == 1 and after[1].where("doc_id is null").count() == 2
    assert counts[2] == counts[1] and after[3].where("text is null").count() == 0 and after[4].where("not decoded").count() == 0


def test_an_empty_corpus_stays_empty(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
