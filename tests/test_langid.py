import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import langid as LI
from corpusloom.operators import language as L

SYLLABLES = {
    "eu": "etxe ko tza rri zen ak dut gara eta bat",
    "ha": "wa da ba ki sa na gi ya yi ka",
    "sw": "ku wa ki li na mbo ni cha vyo ku",
    "ur": "کا کی کے ہے میں سے اور نے پر یہ",
    "ne": "को मा ले र छ यो हो न का ला",
}


def said(rng, lang, n=25):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 3))) for _ in range(n)) + "."


def labelled(n=60):
    rng = random.Random(3)
    return [(i, said(rng, lang), lang) for i, lang in enumerate([*SYLLABLES] * n)] + [(9001, None, "eu"), (9002, "", "ha"), (9003, "no label", None)]


def test_held_out_texts_of_many_languages(spark):
    df = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    for r in LI.held_out_accuracy(df, "doc_id").where("lang <> 'x'").collect():
        assert r.n_right / r.n > 0.9, r


def test_counts_weights_and_unknown_texts(spark):
    rows = labelled(20)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = Counter()
    for _, text, lang in rows:
        s = " " + " ".join("".join(c if c.isalpha() or "ऀ" <= c <= "ॣ" else " " for c in (text or "").lower()).split()) + " "
        if lang and s.strip():
            want.update((lang, ((ord(s[i]) * 131 + ord(s[i + 1])) * 131 + ord(s[i + 2])) % LI.BUCKETS) for i in range(len(s) - 2))
    assert {(r.lang, r.bucket): r.n for r in LI.trigram_counts(df.repartition(5)).collect()} == want
    model = LI.fit_languages(df)
    total = sum(n for (lang, _), n in want.items() if lang == "sw")
    (_, bucket), n = next(x for x in want.items() if x[0][0] == "sw")
    assert model.weights[model.languages.index("sw"), bucket] == round(1000 * np.log((n + 1) / (total + LI.BUCKETS)))
    odd = [(0, None), (1, " \n "), (2, "12 34 !!"), (3, "ไม่รู้จักภาษานี้เลย"), (4, "\n\n" + rows[2][1] + "\n" + rows[0][1] * 5), (5, "q")]
    got = {r.i: r.x for r in spark.createDataFrame(odd, "i int, t string").select("i", L.language_of(F.col("t"), model).alias("x")).collect()}
    assert got == {0: "und", 1: "und", 2: "und", 3: "und", 4: "sw", 5: "und"}


def test_no_labels_and_too_many(spark, monkeypatch):
    none = LI.fit_languages(spark.createDataFrame([], "text string, lang string"))
    assert spark.range(1).select(none.language_of(F.lit("text"))).first()[0] == "und"
    monkeypatch.setattr(LI, "MOST_LANGUAGES", 3)
    with pytest.raises(ValueError, match="languages"):
        LI.fit_languages(spark.createDataFrame(labelled(2), "doc_id long, text string, lang string"))
