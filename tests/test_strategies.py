"""Chains of model steps with the echo backend, and the dependency splitter."""

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.inference import EchoBackend
from corpusloom.plans import strategies as S


@pytest.mark.parametrize("name", sorted(S.STRATEGIES))
def test_every_strategy_returns_each_row_once(spark, name):
    df = spark.createDataFrame([(1, "one sentence"), (2, "another"), (3, "another")], "id long, sentence string")
    out = S.STRATEGIES[name](df, "English", "French").collect()
    assert sorted((r.id, r.sentence) for r in out) == [(1, "one sentence"), (2, "another"), (3, "another")]
    assert all(r.translation for r in out)


def test_refining_dividing_and_analysis(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id long, sentence string, translation string")
    assert S.refined(df, "English", "French", 2).count() == 1
    assert S.divided(df.drop("translation"), 3).first().propositions == []
    assert S.with_analysis(df.drop("translation"), F.lit("NOUN"), "English", "French").first().translation == "a"


def test_dependency_parts_cover_the_sentence_in_order():
    words = "the old man saw a very big dog".split()
    heads = [2, 2, 3, 3, 7, 6, 7, 3]
    assert S.dependency_parts(words, heads) == ["the old man", "saw", "a very big dog"]
    assert S.dependency_parts(["hi"], [0]) == ["hi"]


def test_parallel_pairs_and_codes(spark):
    from corpusloom.sources import corpora

    rows = [("f", lang, "dev", i, f"{lang}{i}") for lang in ("English", "Urdu") for i in range(3)]
    corpus = spark.createDataFrame(rows, "dataset string, language string, split string, row_id int, sentence string")
    got = corpora.parallel_pairs(corpus, "English", "Urdu", size=2).orderBy("row_id").collect()
    assert [(r.source, r.target) for r in got] == [("English0", "Urdu0"), ("English1", "Urdu1")]
    codes = {r.language: r.code for r in corpora.with_code(spark.createDataFrame([("Urdu",), ("Klingon",)], "language string")).collect()}
    assert codes == {"Urdu": "urd_Arab", "Klingon": None}


class Upper(EchoBackend):
    """Answers with the last line in capitals; several answers differ by a mark."""

    def generate(self, prompts, sampling):
        return [[p.rstrip().rsplit("\n", 1)[-1].upper() + "!" * i for i in range(sampling.num_return_sequences)] for p in prompts]

    def score(self, sources, candidates, references):
        return [float(len(c)) for c in candidates]


def test_every_method_translates_every_sentence(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two")], "id long, sentence string")
    words = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(w, F.lit("/X"))), " ")
    for method in ("vanilla", "cot", "maps", "step_by_step", "tear", "nllb", "pos", "morph", "dep", "ner", "none"):
        extra = {"parser": words} if method in S.ANALYSES else {}
        out = S.translate(df, method, "English", "French", Upper, **extra).collect()
        assert sorted(r.id for r in out) == [1, 2, 3] and all(r.translation for r in out), method
    assert {r.translation for r in S.translate(df, "nllb", "English", "French", Upper).collect()} == {"ONE TWO", "THREE"}
    with pytest.raises(ValueError):
        S.translate(df, "other", "English", "French")
    with pytest.raises(ValueError):
        S.translate(df, "pos", "English", "French")


def test_best_of_several_and_quality(spark):
    df = spark.createDataFrame([(1, "one"), (2, "three")], "id long, sentence string")
    assert {r.translation for r in S.best_of(df, "English", "French", 3, Upper).collect()} == {"ONE!!", "THREE!!"}
    rows = spark.createDataFrame([(1, "s", "abc"), (2, "s", "a"), (3, "s", None), (4, "s", "abcdefghij")], "id long, s string, c string")
    got = {r.id: (r.score, r.quality) for r in S.quality(rows, "s", "c", low=2, high=5, lower_is_better=True, factory=Upper).collect()}
    assert got == {1: (3.0, -3.0), 2: (2.0, -2.0), 3: (None, None), 4: (5.0, -5.0)}


def test_parts_are_merged_if_they_are_good(spark):
    parents = spark.createDataFrame([(1, "one two"), (2, "three")], "id long, sentence string")
    children = spark.createDataFrame([(1, 1, "two", "deux"), (1, 0, "one", "un"), (1, 2, "x", " "), (2, 0, "three", "bad")], "id long, pos int, text string, translation string")
    class Spy(EchoBackend):
        def generate(self, prompts, sampling):
            return [["found\n\nnotes" if "deux" in p and p.index("un\n") < p.index("deux") and "English: x" not in p else "alone"] for p in prompts]

    out = {r.id: r.translation for r in S.merged(parents, children, "English", "French", lambda c: c != "bad", Spy).collect()}
    assert out == {1: "found", 2: "alone"}
