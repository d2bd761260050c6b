import random
import sys
import types
from functools import partial

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import prompts as PR
from corpusloom.operators import backends as B
from corpusloom.operators import judging as J
from corpusloom.operators import language as L
from corpusloom.operators import retriever as R
from corpusloom.operators.inference import EchoBackend, Sampling
from corpusloom.plans import self_instruct as SI
from corpusloom.sources import codes, corpora


def test_languages_and_ties(spark):
    texts = [(0, "The cat is on the mat"), (1, "le chat est sur la table\nthe the the the"), (2, "der Hund und die Katze"), (3, "el perro y la casa, que sí"), (4, "xyz"), (5, None), (6, " \n "), (7, "the der")]
    got = {r.i: r.l for r in spark.createDataFrame(texts, "i int, t string").select("i", L.language_of(F.col("t")).alias("l")).collect()}
    assert got == {0: "en", 1: "fr", 2: "de", 3: "es", 4: "und", 5: "und", 6: "und", 7: "en"}
    own = {"a": "foo", "b": "bar baz"}
    assert spark.range(1).select(L.language_of(F.lit("bar foo baz"), own)).first()[0] == "b"


def test_tied_choice_prefers_the_language_and_tosses_otherwise(spark):
    rows = [(i, "the cat is here" if i % 4 in (0, 1) else "xx", "the dog is there" if i % 4 in (0, 2) else "yy") for i in range(200)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    got = L.tied_choice(df, "a", "b", "en", "k").collect()
    assert all(r.choice == (r.a if r.k % 4 == 1 else r.b) for r in got if r.k % 4 in (1, 2))
    tossed = [r.choice == r.a for r in got if r.k % 4 in (0, 3)]
    assert 30 < sum(tossed) < 70
    assert sorted(L.tied_choice(df.repartition(5), "a", "b", "en", "k").collect()) == sorted(got)


def test_evaluated_languages(spark):
    runs = spark.createDataFrame([("Amharic",), ("Hausa",), ("Burmese",)], "tgt string")
    assert {r.tgt for r in L.evaluated(runs, "flores").collect()} == {"Amharic", "Burmese"} and L.evaluated(runs, "other").count() == 3


def test_strategies_side_by_side(spark):
    rows = [("x", s, i, float(v)) for s, vs in (("a", [1, 2, 3]), ("b", [1, 5, 1]), ("c", [0, 0, 9])) for i, v in enumerate(vs)] + [("y", "a", 0, 1.0)]
    df = spark.createDataFrame(rows, "lang string, strategy string, row int, v double")
    assert sorted(map(tuple, J.strategy_pairs(df, ["lang"]).collect())) == [("x", "a", "b"), ("x", "a", "c"), ("x", "b", "c")]
    wins = J.win_rates(J.segment_pairs(df, ["lang"], "row", "strategy", "v"), ["a", "b"], "v_a", "v_b").collect()
    assert sorted(map(tuple, wins)) == [("a", "b", 1, 1, 1), ("a", "c", 2, 1, 0), ("b", "c", 2, 1, 0)]
    scores = J.system_scores(df.union(spark.createDataFrame([("x", "a", 9, None)], df.schema)), ["lang", "strategy"], "v", 2).collect()
    assert {(r.lang, r.strategy): (r.n, r.score) for r in scores}["x", "a"] == (3, 2.0)


def test_rankers_and_topic_judges(spark):
    df = spark.createDataFrame([(1, "s", " long one ", "short"), (2, "s", "a", "bb"), (3, "s", None, "b"), (4, "s", "xx", "yy")], "i int, s string, a string, b string")
    assert {r.i: r.winner for r in J.rank_pairs(df, "s", "a", "b", batch_size=2).collect()} == {1: "A", 2: "B", 3: None, 4: "A"}
    said = spark.createDataFrame([("<reasoning>no</reasoning>\n<answer>\nYES\n</answer>",), ("<answer>No</answer>",), ("maybe",), (None,)], "t string")
    assert [r[0] for r in said.select(J.yes_or_no(F.col("t"))).collect()] == [True, False, None, None]

    class Judge(EchoBackend):
        def generate(self, prompts, sampling):
            return [["<answer>Yes</answer>" if "English paragraph" in p else "<answer>no</answer>"] for p in prompts]

    docs = spark.createDataFrame([(i, f"text {i % 2}", ["a", "b"], "Hausa", "rain") for i in range(131)], "i int, text string, tr array<string>, lang string, topic string")
    got = J.topic_alignment(docs, "text", "tr", "lang", "topic", Judge).collect()
    assert len(got) == 131 and {(r.source_on_topic, r.target_on_topic) for r in got} == {(False, True)}


def test_stems_and_retrievers_by_name(spark):
    pool = spark.createDataFrame([(1, "the red cats"), (2, "a blue dog"), (3, "red dogs and cats"), (4, "green")], "item_id long, text string")
    q = spark.createDataFrame([(7, "cat red")], "query_id long, text string")
    best = R.Retriever("bm25s", pool, language="english").query(q, 2).orderBy("pos").collect()
    assert {r.item_id for r in best} == {1, 3} and best[-1].item_id == 1
    for kind in ("rank_bm25", "random", "lcs", "subsequence", "histogram", "embedding"):
        rows = R.Retriever(kind, pool).query(q, 2).collect()
        assert 0 < len(rows) <= 2 and {r.query_id for r in rows} == {7} and [f.dataType.simpleString() for f in R.Retriever(kind, pool).query(q, 2).schema] == ["bigint"] * 3, kind
    with pytest.raises(ValueError):
        R.Retriever("structural", pool)
    parts = spark.createDataFrame([(7, 1, "red cats"), (7, 2, "blue"), (8, 1, "green")], "query_id long, part int, text string")
    found = R.Retriever("bm25s_structural", pool).query(parts, 2).collect()
    assert {(r.query_id, r.item_id) for r in found} >= {(7, 2), (8, 4)} and sum(r.query_id == 7 for r in found) == 2


class Fake:
    """Answers every attribute and call with itself and remembers calls."""

    def __init__(self, answer):
        self.answer, self.calls = answer, []

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return self

    def __call__(self, *args, **kwargs):
        self.calls.append((args, kwargs))
        return self.answer(*args, **kwargs) if "messages" in kwargs or "prompt" in kwargs else self


def test_hosted_services(monkeypatch):
    say = lambda text: types.SimpleNamespace(content=[types.SimpleNamespace(text=text)], message=types.SimpleNamespace(content=[types.SimpleNamespace(text=text)]), choices=[types.SimpleNamespace(text=text, message=types.SimpleNamespace(content=text))])
    for service in ("openai", "anthropic", "cohere"):
        fake = Fake(lambda **kw: say("to " + (kw["prompt"] if "prompt" in kw else kw["messages"][-1]["content"])))
        monkeypatch.setitem(sys.modules, service, fake)
        for extra in ({}, {"system": "be kind"}, *([{"completions": True}] if service == "openai" else [])):
            client = partial(B.ChatService, service, "m", **extra)()
            assert client.generate(["a", "b"], Sampling(num_return_sequences=2)) == [["to a", "to a"], ["to b", "to b"]]
    with pytest.raises(ValueError):
        B.ChatService("other", "m")
    monkeypatch.setitem(sys.modules, "vllm", None)
    with pytest.raises(ImportError, match="vllm"):
        B.ServingEngine("m")
    with pytest.raises(NotImplementedError):
        client.embed(["x"])


def test_local_engines(monkeypatch):
    class Engine:
        def __init__(self, **kw):
            assert kw["tensor_parallel_size"] == 2

        def generate(self, prompts, settings, lora_request):
            return [types.SimpleNamespace(outputs=[types.SimpleNamespace(text=p + str(i)) for i in range(settings["n"])]) for p in prompts]

        def beam_search(self, prompts, settings):
            return [types.SimpleNamespace(sequences=[types.SimpleNamespace(text=p["prompt"] + "!" * i) for i in range(settings["beam_width"])]) for p in prompts]

    monkeypatch.setitem(sys.modules, "vllm", types.SimpleNamespace(LLM=Engine, SamplingParams=lambda **kw: kw))
    monkeypatch.setitem(sys.modules, "vllm.sampling_params", types.SimpleNamespace(BeamSearchParams=lambda **kw: kw))
    engine = B.ServingEngine("m", tensor_parallel=2)
    assert engine.generate(["x"], Sampling(num_return_sequences=2)) == [["x0", "x1"]]
    assert engine.generate(["x"], Sampling(num_return_sequences=2, num_beams=3)) == [["", "!"]]

    class Batch(dict):
        def to(self, device):
            return self

    class Mask:
        def tolist(self):
            return [[1, 1, 1], [1, 0, 0]]

    asked = {}

    class Model:
        def to(self, device):
            return self

        def generate(self, **kw):
            asked.update(kw)
            return ["t0", "t1", "t2", "t3"]

    tokenizer = types.SimpleNamespace(convert_tokens_to_ids=lambda t: {"fra_Latn": 9}[t], batch_decode=lambda out, skip_special_tokens: out)
    token = type("Tokenizer", (), {"__call__": lambda self, texts, **kw: Batch(attention_mask=Mask()), "convert_tokens_to_ids": staticmethod(tokenizer.convert_tokens_to_ids), "batch_decode": staticmethod(tokenizer.batch_decode)})()
    monkeypatch.setitem(sys.modules, "transformers", types.SimpleNamespace(AutoTokenizer=types.SimpleNamespace(from_pretrained=lambda *a, **k: token), AutoModelForSeq2SeqLM=types.SimpleNamespace(from_pretrained=lambda *a, **k: Model())))
    out = B.TranslationModel("m", "eng_Latn", "fra_Latn").generate(["a", "b"], Sampling(num_return_sequences=2))
    assert out == [["t0", "t1"], ["t2", "t3"]] and asked["max_new_tokens"] == 6 and asked["num_beams"] == 5 and asked["forced_bos_token_id"] == 9


def test_draws_are_different_and_repeatable(spark):
    df = spark.range(200).select("id", SI.drawn(5, F.lit(12).cast("long"), F.lit(1), F.col("id")).alias("d"), SI.drawn(9, F.lit(4).cast("long"), F.lit(1), F.col("id")).alias("all"), SI.drawn(3, F.lit(0).cast("long"), F.col("id")).alias("none"))
    rows = df.collect()
    assert all(len(set(r.d)) == 5 and set(r.d) <= set(range(12)) and set(r["all"]) == set(range(4)) and r.none == [] for r in rows)
    assert len({tuple(r.d) for r in rows}) > 20 and df.repartition(7).orderBy("id").collect() == rows


def test_examples_are_mixed_and_passages_come_back(spark):
    seeds = spark.createDataFrame([("en", f"seed {i}") for i in range(9)] + [("fr", f"graine {i}") for i in range(9)], "language string, text string")
    made = spark.createDataFrame([("en", f"made {i}") for i in range(4)], "language string, text string")
    asked = spark.createDataFrame([(f"{lang}{i}", lang) for lang in ("en", "fr") for i in range(20)], "prompt_id string, language string")
    for r in SI.mixed_examples(asked, seeds, made, 6, 2).collect():
        kinds = sorted(x.split()[0] for x in r.examples)
        assert kinds == (["made"] * 2 + ["seed"] * 4 if r.language == "en" else ["graine"] * 6)
    prompt = spark.createDataFrame([(["a", "b"],)], "e array<string>").select(SI.list_prompt(F.lit("Hausa"), F.col("e"))).first()[0]
    assert prompt.endswith("1. a\n\n##\n\n2. b\n\n##") and "Hausa" in prompt
    answer = spark.createDataFrame([("3. one\n\n##\n\n4.  two words\n##\n \n##",)], "a string").select(SI.listed_passages(F.col("a"))).first()[0]
    assert answer == ["one", "two words"]
    passages = spark.createDataFrame([(lang, i, f"{lang} {i}") for lang in ("x", "y", "z") for i in range(5)], "language string, row_id long, text string")
    for r in SI.demonstrations(asked, passages, ["x", "y", "z"], 5, 3).collect():
        lines = r.examples.split("\n\n")
        assert [x[:3] for x in lines] == ["1. ", "2. ", "3. "] and len({x[3] for x in lines}) == 3 and len({x[-1] for x in lines}) == 3


class ListBackend(EchoBackend):
    def generate(self, prompts, sampling):
        rng = random.Random(len(prompts[0]))
        words = [w for p in prompts for w in p.split() if w.isalpha()]
        return [["\n\n##\n\n".join(f"{i}. " + " ".join(rng.sample(words, 9)) for i in range(3))] for _ in prompts]


def test_self_instruction_goes_on_until_there_is_enough(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(300)]
    seeds = spark.createDataFrame([("en", " ".join(rng.sample(vocabulary, 8))) for _ in range(12)], "language string, text string")
    rounds = []

    def save(df, r):
        df.write.mode("append").parquet(f"{tmp_path}/made")
        rounds.append(r)
        return spark.read.parquet(f"{tmp_path}/made")

    made = SI.self_instruct(seeds, 5, 4, 1, 3, save, factory=ListBackend)
    assert made.count() >= 5 and made.distinct().count() == made.count() and len(rounds) < 10
    silent = lambda df, r: df if r < 0 else made.limit(0)
    assert SI.self_instruct(seeds, 5, 4, 1, 3, silent, most_empty=2, factory=ListBackend).count() == 0


def test_neighbour_rounds_double_the_pool(spark):
    pool = spark.createDataFrame([(i, f"text {i}", [float(i % 3), 1.0, 0.5] + [0.0] * 13) for i in range(6)], "item_id long, text string, v array<double>")

    class Next(EchoBackend):
        def generate(self, prompts, sampling):
            return [["  fresh line\nsecond\n4. more"] for _ in prompts]

    out = SI.neighbour_rounds(pool, 2, 2, lambda df, r: spark.createDataFrame(df.collect(), df.schema), factory=Next)
    assert out.count() == 24 and out.select("item_id").distinct().count() == 24 and {r.text for r in out.where("item_id > 5 or item_id < 0").collect()} == {"fresh line"}


def test_codes_and_aligned_corpora(spark):
    assert len(codes.FLORES) == 100 and codes.code("flores", "Wolof") == "wol_Latn" and codes.code("tico", "English") == "en"
    with pytest.raises(KeyError):
        codes.code("smol", "Wolof")
    df = spark.createDataFrame([("Hausa",), ("Nowhere",)], "language string")
    assert {r.language: r.code for r in codes.with_codes(df, "smol").collect()} == {"Hausa": "ha", "Nowhere": None}
    pairs = spark.createDataFrame([("Bengali", "validation", 0, " a ", "x"), ("Bengali", "test", 0, "b", "y"), ("Hausa", "test", 0, "c", " z\n")], "language string, split string, row_id long, source string, target string")
    assert sorted(map(tuple, corpora.aligned_benchmark(pairs, "English").collect())) == [("dev", 0, "a"), ("devtest", 0, "b")]
    assert list(map(tuple, corpora.aligned_benchmark(pairs, "Hausa").collect())) == [("devtest", 0, "z")]
    bench = spark.createDataFrame([("dev", 0, "d", 1), ("devtest", 0, "e", 1)], "split string, row_id long, sentence string, more int")
    both = corpora.curated_benchmark(spark.createDataFrame([(5, "s", "t")], "row_id long, source string, target string"), bench, "target")
    assert sorted(map(tuple, both.collect())) == [("dev", 5, "t"), ("devtest", 0, "e")]
    smol = spark.createDataFrame([("ha", "one", "daya"), ("ig", "one", "otu"), ("rw", "one", "rimwe")], "code string, src string, trg string")
    assert {(r.target, r.target_language) for r in corpora.sentence_pairs(smol, ["Hausa", "Igbo"], codes.SMOL).collect()} == {("daya", "Hausa"), ("otu", "Igbo")}
    with pytest.raises(KeyError):
        corpora.sentence_pairs(smol, ["Wolof"], codes.SMOL)
    ctx = spark.createDataFrame([(i, c) for i, c in enumerate("aabba")], "i long, context string")
    assert [tuple(r) for r in corpora.contexts(ctx, "i").orderBy("row_id").collect()] == [(0, "a"), (2, "b"), (4, "a")]
    text = spark.createDataFrame([("hi", "salut")], "s string, t string").select(PR.sample_text(F.col("s"), F.col("t")), PR.sample_text(F.col("s"))).first()
    assert text[0] == "Translate this from English to French:\nEnglish: hi\nFrench: salut" and text[1] == "hi"


def test_vectors_of_several_files_have_numbers_of_their_own(spark, tmp_path):
    import numpy as np

    for name, rows in (("b", 3), ("a", 2), ("c", 4)):
        (tmp_path / name).write_bytes(np.full((rows, 4), ord(name), "<f4").tobytes())
    got = corpora.read_vectors(spark, str(tmp_path), 4).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(9)) and [chr(int(r.embedding[0])) for r in got] == list("aabbbcccc")


def test_marks_of_all_scripts_go(spark):
    import unicodedata

    from corpusloom.functions import text as T

    texts = ["Été naïve x_1", "हिन्दी में नमस्ते", "עִבְרִית", "العَرَبِيَّة ١٢", "ไทยที่", "한국어"]
    want = [[w for w in __import__("regex").findall(r"[\p{L}\p{N}_]+", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn").lower())] for t in texts]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.normalised_tokens(F.col("t"))).collect()]
    assert got == want


def test_sentences_after_abbreviations_and_tokens_of_any_script(spark):
    from corpusloom.functions import text as T

    one = spark.createDataFrame([("Mr. Smith met Dr.  Who. They spoke. St. Ives!",)], "t string")
    assert one.select(T.sentences(F.col("t"), T.ABBREVIATIONS["English"])).first()[0] == ["Mr. Smith met Dr. Who.", "They spoke.", "St. Ives!"]
    assert one.select(F.size(T.sentences(F.col("t")))).first()[0] == 6
    assert spark.createDataFrame([("नमस्ते दुनिया, Été 5!",)], "t string").select(T.unicode_tokens(F.col("t"))).first()[0] == ["नमस्ते", "दुनिया", "été", "5"]


def test_line_benchmarks_and_dependency_splits(spark, tmp_path):
    from corpusloom.plans import strategies

    for split, text in (("dev", "a\n\nb\n"), ("devtest", "c")):
        (tmp_path / split).mkdir()
        (tmp_path / split / f"nqo_Nkoo.{split}").write_text(text)
    got = corpora.line_benchmark(spark, str(tmp_path), "nqo_Nkoo").collect()
    assert sorted(map(tuple, got)) == [("dev", 0, "a"), ("dev", 1, ""), ("dev", 2, "b"), ("devtest", 0, "c")]
    rows = [(1, "the old man saw a very big dog".split(), [2, 2, 3, 3, 7, 6, 7, 3]), (2, ["hi"], [0]), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, w array<string>, h array<int>")
    assert [r.parts for r in strategies.split_by_dependencies(df, "w", "h").orderBy("id").collect()] == [["the old man", "saw", "a very big dog"], ["hi"], None]


def test_a_share_of_its_own_for_long_items(spark):
    from corpusloom.operators import similarity as S

    pool = spark.createDataFrame([(1, ["x"] + ["y"] * 200), (2, ["z"]), (3, ["z"]), (4, ["w"])], "item_id long, tokens array<string>")
    q = spark.createDataFrame([(1, ["x"])], "query_id long, tokens array<string>")
    plain, plus = (S.bm25_top_k(q, pool, 1, delta=d).first().score for d in (0.0, 1.5))
    idf = __import__("math").log((4 - 1 + 0.5) / 1.5)
    assert plus - plain == pytest.approx(1.5 * idf, abs=1e-5)


def test_tasks_of_every_kind(spark):
    df = spark.createDataFrame([("s", ["a", "b"], ["x", "y"], "t")], "s string, p array<string>, q array<string>, t string")
    said = {k: df.select(PR.merge_task(k, F.col("s"), F.col("p"), F.col("q"), "English", "French")).first()[0] for k in PR.MERGES}
    assert said["vanilla"] == "English: a\nFrench: x\n\nEnglish: b\nFrench: y\n\nEnglish: s\nFrench:"
    assert "a\n" not in said["zero-shot"] and "III. Final translation" in said["refine"] and "III." not in said["norefine"] and len(set(said.values())) == 4
    for k in PR.DIVISIONS:
        out = df.select(PR.division_task(k, F.col("s"), [("one two", ["one", "two"])])).first()[0]
        assert out.endswith("Sentence: one two\n1. one\n2. two\n\nSentence: s\n1.")
    for name, (_, wants) in PR.JUDGES.items():
        out = df.select(PR.judge_task(name, F.col("s"), F.col("t"), "English", "French", F.lit("ref") if wants else None)).first()[0]
        assert out.endswith("French translation: t\nAnswer:") and ("reference: ref" in out) == wants
    with pytest.raises(ValueError):
        PR.judge_task("score-ref", F.col("s"), F.col("t"), "English", "French")
    with pytest.raises(ValueError):
        PR.merge_task("other", F.col("s"), F.col("p"), F.col("q"), "English", "French")
    out = df.select(PR.rubric_task(F.col("s"), F.lit("A1"), F.lit("B1"), F.lit("R1"), F.lit("ref")), PR.topic_task(F.lit("Hausa"), F.lit("rain"), F.col("p"), F.array().cast("array<string>"), 3)).first()
    assert "Reference:\nref" in out[0] and out[0].endswith("Feedback:") and "Phrases" not in out[1] and "a\n\nb" in out[1] and out[1].endswith("1.")
