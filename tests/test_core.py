"""Small goldens and properties of the core operators."""

import hashlib
import inspect
import json
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import parsers as P
from corpusloom.functions import prompts as PR
from corpusloom.functions import text as T
from corpusloom.operators import decon as D
from corpusloom.operators import gates as G
from corpusloom.operators import inference as I
from corpusloom.operators import metrics as M
from corpusloom.operators import packing as K
from corpusloom.operators import reshape as R
from corpusloom.operators import selection as S
from corpusloom.operators import similarity as SIM
from corpusloom.operators import trees as TR
from corpusloom.plans import rounds, search_queries, select_queries
from corpusloom.sources import corpora


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [
        (lambda x: T.numbered_items(x, F.lit(2)), "ok\n1. alpha\n2. beta", ["alpha", "beta"]),
        (lambda x: T.numbered_items(x, F.lit(2)), "1. only", None),
        (lambda x: T.numbered_items(x), "1. \na\n2. \nb", ["a", "b"]),
        (lambda x: T.truncate_at(x, ["###"]), "abc  ### tail", "abc"),
        (T.topic_phrase, "a, b, c", "a, b and c"),
        (T.topic_phrase, "a", "a"),
        (lambda x: T.danda_sentences(x, T.DANDA["Nepali"]), "क। ख", ["क।", "ख।"]),
        (lambda x: F.size(T.ngrams(T.words(x), 10)), "a b c d e f g h i", 0),
        (lambda x: F.size(T.ngrams(T.words(x), 10)), "a b c d e f g h i j", 1),
        (P.score, "Score: 85", 85),
        (P.score, "85 or 90", None),
        (P.score, "101", None),
        (P.score, "['70']", 70),
        (lambda x: P.score(x), "80/100", 80),
        (P.stars, "Four stars", 4),
        (P.stars, "** or 3 stars", None),
        (lambda x: P.class_index(x, P.CLASSES), "a perfect translation!", 4),
        (P.verdict, "x [RESULT] A\nB", "A"),
        (lambda x: T.highest_count(T.char_bigrams(T.longest_word(x))), "a b", 0),
        (lambda x: T.equal_parts(x, 2), "aaaa bbbb cccc dddd", ["aaaa bbbb cccc", "dddd"]),
        (lambda x: T.regrouped(T.words(x), 2), "a b c", ["a b", "c"]),
        (lambda x: T.final_line(x, "refine"), "II. x\nIII. Final translation\n done \nmore", "done "),
        (lambda x: T.without_trailing_repeat(x, 3), "q a b a b a b", "q a b"),
        (lambda x: T.keywords(x, ["the"], 2), "The cat, 123 the dogs cat bird", ["cat", "dogs"]),
        (lambda x: T.by_place(F.array(F.lit("b"), F.lit("a")), x), "xa b", ["a", "b"]),
        (lambda x: T.find_sublist(T.words(x), F.array(F.lit("b"), F.lit("c"))), "a b c", 1),
        (T.flattened, " a \n\n b ", "a b"),
        (lambda x: T.proposition_items(x, 2), "1. a\n2. b\n3. c", ["a", "b"]),
        (T.candidate_text, "# short text here\n\nrest", "short text here"),
    ],
)
def test_expressions(spark, expr, value, want):
    assert col(spark, [value], expr) == [want]


def test_pair_gate_counts_ordered_pairs(spark):
    texts = [" ".join(["alpha"] * 13 + ["bravo"] * 12), " ".join(["alpha"] * 18), "tiny words here"]
    assert col(spark, texts, T.highest_pair_count) == [156, 153, 0]


def test_gates(spark):
    df = spark.createDataFrame([("123456789", "x" * 12), ("a#" * 10, "x" * 12), ("good source text", "good target text")], "source string, target string")
    assert [r.source for r in G.pair_gate(df).collect()] == ["good source text"]
    n = spark.createDataFrame([(1, ["a", "b"], [1.0, None])], "i int, t array<string>, s array<double>")
    out = G.gate_nested(n, lambda z: z["t"] == "b", ["t", "s"]).first()
    assert (out.t, out.s) == (["b"], [None])
    runs = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "run string, row_id int")
    assert sorted((r.run, r.row_id) for r in G.complete_runs(runs, 2).collect()) == [("a", 0), ("a", 1)]
    long = spark.createDataFrame([("w " * 200,), ("a fine little text",)], "text string")
    assert [r.text for r in G.repetition_gates(long).collect()] == ["a fine little text"]


def test_decontamination(spark):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words[5:20])), (2, "É" + " ".join(words[30:])), (3, "short")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words[:16])), (8, " ".join(words[:16]))], "item_id long, text string")
    hits = D.contamination(docs, D.ngram_index(bench)).collect()
    assert [(r.doc_id, r.item_id, r.ngram) for r in hits] == [(1, 8, " ".join(words[5:15]))]
    assert [r.doc_id for r in D.without_contaminated(docs, D.contamination(docs, D.ngram_index(bench))).orderBy("doc_id").collect()] == [2, 3]
    report = D.contamination_report(docs, bench).first()
    assert report.longest_diff_part_length == len(" ".join(words[5:16])) and 0 < report.diff_ratio <= 1
    nested = spark.createDataFrame([(1, ["bad", "bad"], [1.0, 2.0]), (2, ["ok"], [3.0])], "doc_id long, t array<string>, s array<double>")
    bad = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, pos int")
    assert {r.doc_id: r.t for r in D.without_contaminated_elements(nested, bad, "doc_id", ["t", "s"]).collect()} == {1: [], 2: ["ok"]}


def test_selection(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, None)], "id long, s double")
    assert [r.id for r in S.above_percentile(df, "s", 50).collect()] == [3]
    assert [r.id for r in S.highest(df, "s", 4, "id").collect()] == [3, 2, 1, 4]
    assert [r.id for r in S.soonest(df, 10, "id").collect()] == [1, 2, 3, 4]
    rows = spark.range(1000)
    for want, test in ((100, 0.1), (37, 37), (1000, 5000), (0, 0.0)):
        parts = [{r.id: r.split for r in S.train_test(rows.repartition(n), "id", test, 5).collect()} for n in (1, 7)]
        assert parts[0] == parts[1] and sum(v == "test" for v in parts[0].values()) == want


def test_reshape(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, [], [])], "id long, t array<string>, n array<int>")
    back = {r.id: (r.t, r.n) for r in R.nested(R.flattened(df, "id", ["t", "n"]), "id", ["t", "n"], df).collect()}
    assert back == {1: (["a", "b"], [1, 2]), 2: ([], [])}
    runs = spark.createDataFrame([(i, "g", x) for i, x in enumerate(["x", "x ", "y", "x"])], "i int, g string, v string")
    assert [r.i for r in R.run_heads(runs, "i", "v", "g").orderBy("i").collect()] == [0, 2, 3]


@settings(max_examples=15, deadline=None, derandomize=True)
@given(st.lists(st.integers(0, 9), max_size=12), st.integers(1, 6))
def test_packing_keeps_all_tokens_but_the_tail(spark, sizes, block):
    rows = [(i * 5000, [f"{i}.{k}" for k in range(n)]) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    got = [x for r in K.packed(df, "id", "t", block).orderBy("block_id").collect() for x in r.tokens]
    flat = [x for _, t in rows for x in t]
    assert got == flat[: len(flat) // block * block]


def test_labels_and_padding(spark):
    df = spark.createDataFrame([([1, 2], [3])], "p array<int>, t array<int>")
    ids, labels = K.target_labels(F.col("p"), F.col("t"), F.lit(9))
    assert tuple(df.select(ids, labels).first()) == ([1, 2, 3, 9], [-100, -100, 3, 9])
    assert df.select(K.padded(F.col("p"), 4, 0), K.padded(F.col("p"), 1, 0)).first()[:] == ([1, 2, 0, 0], [1])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(row[j], old[j + 1])
    return row[-1]


def test_common_subsequences(spark):
    rng = random.Random(1)
    rows = [(list("ABCBDAB"), list("BDCABA")), ([], list("A")), ([], [])] + [(rng.choices("abc", k=rng.randint(0, 80)), rng.choices("abc", k=rng.randint(0, 80))) for _ in range(20)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    got = [(r.lcs, r.n) for r in SIM.with_lcs(df, "a", "b").withColumn("n", SIM.lcs_length(F.col("a"), F.col("b"))).collect()]
    assert got == [(lcs(a, b),) * 2 for a, b in rows] and got[0] == (4, 4)


def best_lcs(queries, pool, k, least, exclude_self):
    want = set()
    for q, x in queries:
        scored = sorted((-lcs(x or [], y or []), i) for i, y in pool if not (exclude_self and i == q))
        best = [(i, -n) for n, i in scored if -n >= least][:k]
        want |= {(q, i, n, len(best) - r) for r, (i, n) in enumerate(best)}
    return want


def test_lcs_queries_rank_every_document(spark, tmp_path):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(14)]
    items = [[rng.choice(words) for _ in range(rng.randint(0, 30))] for _ in range(25)]
    # documents with all words of an item in other order come first in shared words, not in common subsequences
    texts = [rng.sample(words, 14) + ["x"] * rng.randint(0, 9) for _ in range(60)] + [rng.choice(items)[:12] for _ in range(40)] + [[], ["w0"]]
    b, d = list(enumerate(items)), list(enumerate(texts))
    as_text = lambda rows: [(i, " ".join(x)) for i, x in rows]
    spark.createDataFrame(as_text(b), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(as_text(d), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda df: {(r.query_id, r.item_id, r.score, r.pos) for r in df.collect()}
    assert found(search_queries.lcs_topk_long(spark, str(tmp_path))) == best_lcs(b, d, 5, 1, False)
    # whole texts: the first twelve words are the same everywhere, and items from 20 on count
    b = [(i, [f"h{j}" for j in range(12)] + x) for i, x in b]
    spark.createDataFrame(as_text(b), "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert found(search_queries.lcs_topk(spark, str(tmp_path))) == best_lcs(b, b, 3, 0, True)


def test_lcs_top_k_in_blocks_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, None if i == 3 else [rng.choice("abcde") for _ in range(rng.randint(0, 12))]) for i in range(50)]
    df = spark.createDataFrame(rows, "item_id long, tokens array<string>")
    for least, exclude in ((0, True), (1, False)):
        got = SIM.lcs_top_k(df.withColumnRenamed("item_id", "query_id"), df, 3, least, exclude, block=7, shard=9)
        assert {(r.query_id, r.item_id, r.score, r.pos) for r in got.collect()} == best_lcs(rows, rows, 3, least, exclude)


def test_near_pairs_lose_nothing_and_greedy_equals_the_loop(spark):
    rng = random.Random(2)
    base = [rng.choices("abcdefghij", k=rng.randint(1, 25)) for _ in range(25)]
    rows = [(i, "g", base[i % 25] if i < 25 else [w if rng.random() < 0.85 else "z" for w in base[i % 25]]) for i in range(100)] + [(100, "g", []), (101, "g", [])]
    df = spark.createDataFrame(rows, "doc_id long, g string, t array<string>")
    pairs = SIM.near_pairs(df, "t", 0.7, "g")
    f = lambda a, b: 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0
    want = {(i, j) for i, _, a in rows for j, _, b in rows if i < j and f(a, b) > 0.7}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    kept = []
    for i, _, t in rows:
        if all(f(t, rows[k][2]) <= 0.7 for k in kept):
            kept.append(i)
    assert sorted(r.doc_id for r in SIM.greedy_kept(df, pairs).collect()) == kept
    again = df.union(df.selectExpr("doc_id + 1000", "g", "t").where("doc_id % 3 = 0")).union(spark.createDataFrame([(5000, None, ["a"]), (5001, None, ["a"]), (5002, "g", None)], df.schema))
    assert sorted(r.doc_id for r in SIM.greedy_unlike(again, "t", 0.7, "g").collect()) == sorted([*kept, *(i + 1000 for i, _, t in rows if not t and i % 3 == 0), 5000, 5001, 5002])


def test_long_chains_are_decided_or_refused(spark):
    df, pairs = spark.range(12).toDF("doc_id"), spark.createDataFrame([(i, i + 1) for i in range(11)], "a long, b long")
    assert {r.doc_id for r in SIM.greedy_kept(df, pairs).collect()} == set(range(0, 12, 2))
    with pytest.raises(RuntimeError):
        SIM.greedy_kept(df, pairs, max_rounds=2)
    assert inspect.signature(SIM.greedy_kept).parameters["max_rounds"].default is None


def test_fusion_and_dense(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, item_id long, pos long")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, item_id long, pos long")
    assert [(r.item_id, r.score) for r in SIM.borda(a, b, 3).orderBy("pos").collect()] == [(10, 1.0), (30, 2.0), (20, 4.5)]
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5)).round(3)
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, v array<double>")
    q = p.where("item_id < 7").toDF("query_id", "q")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, 4 - r.pos): r.item_id for r in SIM.dense_top_k(q, p, 3, exclude_self=True, block=2).collect()}
    for i in range(7):
        order = [j for j in np.argsort(-(unit @ unit[i])) if j != i]
        assert [got[i, r] for r in (1, 2, 3)] == order[:3]


def test_metrics(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat")], "i long, h string, r string")
    assert M.corpus_bleu(df, "i", "h", "r").first().bleu == pytest.approx(100) and M.corpus_chrf(df, "i", "h", "r").first().chrf == pytest.approx(100)
    short = spark.createDataFrame([(1, "the cat sat on", "the cat sat on the mat")], "i long, h string, r string")
    assert M.corpus_bleu(short, "i", "h", "r").first().bleu == pytest.approx(100 * math.exp(1 - 6 / 4))
    rng = random.Random(3)
    d = [rng.gauss(0.2, 1) for _ in range(40)]
    t = M.paired_t(spark.createDataFrame([("g", x, 0.0) for x in d], "g string, a double, b double"), "a", "b", ["g"]).first().t
    assert t == pytest.approx(statistics.mean(d) / (statistics.stdev(d) / math.sqrt(40)))
    assert M.t_p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-6) and M.t_p_value(0.0, 5) == pytest.approx(1.0)
    same = spark.createDataFrame([([1.0, 0.0],)] * 5, "v array<double>")
    apart = spark.createDataFrame([([1.0, 0.0],), ([0.0, 2.0],)], "v array<double>")
    assert M.vendi(same, "v") == pytest.approx(1) and M.vendi(apart, "v") == pytest.approx(2)
    c = spark.createDataFrame([(1, 0, " ", 9.0), (1, 1, "a", 1.0), (1, 2, "b", 1.0), (2, 0, "", 5.0)], "g long, pos int, text string, s double")
    assert {r.g: r.text for r in M.best_candidate(c, "g", F.col("s"), "pos", "text").collect()} == {1: "a", 2: ""}


def clipped(pairs, n, split):
    counts = [(Counter(tuple(h[i : i + n]) for i in range(len(h) - n + 1)), Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))) for h, r in ((split(h), split(r)) for h, r in pairs)]
    return sum(sum(h.values()) for h, _ in counts), sum(sum(r.values()) for _, r in counts), sum(sum((h & r).values()) for h, r in counts)


def test_corpus_scores_cover_long_texts_and_unknown_lengths(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["the", "a", "cat", "dog", "sat", "ran"]) for _ in range(n))
    rows = [(i, t, None if i == 1 else len(t)) for i, t in enumerate([text(30), text(40), text(1500), text(900), ""])]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    pairs = [(t.replace(" the ", " of the "), t) for _, t, _ in rows]
    by_word = [clipped(pairs, n, str.split) for n in range(1, 5)]
    hyp, ref, _ = by_word[0]
    want = 100 * math.exp(sum(math.log(m / h) for h, _, m in by_word) / 4 + (0 if hyp >= ref else 1 - ref / hyp))
    assert search_queries.bleu_corpus(spark, str(tmp_path)).first().bleu == pytest.approx(want, abs=2e-6)
    f = [5 * (m / h) * (m / r) / (4 * m / h + m / r) for h, r, m in [clipped(pairs, n, lambda t: list("".join(t.split()))) for n in range(1, 7)] + by_word[:2]]
    assert search_queries.chrf_corpus(spark, str(tmp_path)).first().chrf == pytest.approx(100 * sum(f) / 8, abs=2e-6)


def test_queries_cover_all_rows(spark, tmp_path):
    sf = str(tmp_path)
    docs = [(i, f"one {i}. two\nthree") for i in [*range(5), *range(1000, 1040)]]
    items = [(i, f"a{i} b c") for i in range(40)] + [(1000, "z z")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    nodes = {(r.node_id, r.text) for r in search_queries.tree_root(spark, sf).collect()}
    assert nodes == {x for i, _ in docs for x in ((f"{i}.0.0", f"one {i}"), (f"{i}.0.1", "two"), (f"{i}.1.0", "three"))}
    assert {r.query_id for r in search_queries.histogram_topk(spark, sf).collect()} == {i for i, _ in items}
    depths = {}
    for i, _ in docs:
        depths.setdefault((f"L{i % 3}", i % 5), set()).add(i % 2)
    assert {(r.src, r.k) for r in search_queries.run_pairing(spark, sf).collect()} == {k for k, v in depths.items() if len(v) == 2}
    assert {r.row_id for r in select_queries.zip_pairs(spark, sf).collect()} == {i for i, _ in docs} & {i for i, _ in items}
    draw = lambda b, i: int(hashlib.md5(f"122|{b}|{i}".encode()).hexdigest()[:8], 16) % 20 % 2
    got = {r.resample: r["mean"] for r in search_queries.bootstrap_means(spark, sf).collect()}
    assert got == {b: round(sum(draw(b, i) for i in range(500)) / 500, 6) for b in range(300)}


def sentence_bleu(hyp, ref):
    counts = [clipped([(hyp, ref)], n, str.split) for n in range(1, 5)]
    size, other, hits = counts[0]
    if size < 4 or not hits:
        return 0.0
    logs, miss = 0.0, 1.0
    for total, _, m in counts:
        miss = miss / 2 if not m else miss
        logs += math.log((m or miss) / total)
    return 100 * math.exp(logs / 4 + (0 if size >= other else 1 - other / size))


def test_candidates_are_chosen_by_mutual_bleu(spark):
    texts = ["the cat sat on the mat", "the cat sat on the mat today", "mat the on sat cat the", "mat mat the the on sat cat", " ", "a b c", "", "the cat sat on a mat"]
    rng = random.Random(3)
    rows = [(0, i, t) for i, t in enumerate(["mat the on sat cat the", *texts[:2], "on the mat the cat sat"])] + [(1, i, t) for i, t in enumerate(texts)]
    rows += [(g, i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for g in range(2, 12) for i in range(4)]
    df = spark.createDataFrame(rows, "g long, pos long, text string")
    scores = M.mutual_scores(df, "g", "pos", "text")
    want = {(g, i): sum(sentence_bleu(u, t) for h, j, u in rows if h == g and j != i) for g, i, t in rows}
    assert {(r.g, r.pos): r.score for r in scores.collect()} == pytest.approx(want, abs=2e-6)
    best = M.best_candidate(df.join(scores, ["g", "pos"]), "g", F.col("score"), "pos", "text").where("g = 0").first()
    assert best.pos == max(range(4), key=lambda i: (round(want[0, i], 6), -i)) and best.pos in (1, 2)


def test_prompts_and_chat(spark):
    f = PR.Format.numbered(9, "English", "French")
    df = spark.createDataFrame([([("a", "b")], "c")], "d array<struct<x:string,y:string>>, e string")
    assert df.select(f.column(F.col("d"), F.col("e"))).first()[0] == "English: a\nFrench: b\n###\nEnglish: c\nFrench:"
    chat = spark.createDataFrame([(1, 2, "assistant", "yo"), (1, 0, "system", " be "), (1, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    said = {s: PR.render_conversations(chat, s).first().prompt for s in PR.STYLES}
    assert said["qwen-2.5"] == "<|im_start|>system\nbe<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>assistant\n"
    assert said["llama-2"].startswith("<s> [INST] <<SYS>>\nbe\n<</SYS>>\n\nhi [/INST] yo </s>") and said["zephyr"].startswith("<|system|>\nbe</s> \n<|user|>\nhi</s> ")
    assert PR.render_conversations(chat.where("role = 'user'"), "llama-3").first().prompt.startswith("<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\nYou are a helpful assistant.<|eot_id|>")


def test_trees_and_model_steps(spark):
    df = spark.createDataFrame([(1, "a b|c"), (2, "d")], "id long, text string")
    nodes = TR.decompose(TR.roots(df, "id"), lambda c: F.split(c, r"[| ]"), 1)
    out = TR.merge_up(nodes, lambda c: F.upper(c), lambda text, parts, results: F.array_join(results, "+"), 1)
    assert {r.root_id: r.result for r in out.collect()} == {"1": "A+B+C", "2": "D"}
    asked = spark.createDataFrame([("x\nq1",), ("x\nq1",), ("q2",)], "prompt string")
    first = I.generate(asked, "prompt", sampling=I.Sampling(num_return_sequences=2))
    assert {r.prompt: r.candidates for r in first.collect()} == {"x\nq1": ["q1", "q1"], "q2": ["q2", "q2"]}
    assert I.generate(asked, "prompt", done=first).count() == 0
    assert len(I.embed(asked, "prompt").first().embedding) == 16
    assert I.score(asked, "prompt", "prompt").first().score == 1.0


class Flaky(I.EchoBackend):
    calls = 0

    def generate(self, prompts, sampling):
        Flaky.calls += 1
        if Flaky.calls % 2:
            raise OSError("try again")
        return super().generate(prompts, sampling)


def test_failed_calls_are_retried(spark):
    assert I.generate(spark.createDataFrame([("a",)], "prompt string"), "prompt", Flaky).first().candidates == ["a"]


class Numbered(I.EchoBackend):
    def generate(self, prompts, sampling):
        return [[f"1. {p} one two three four\n2. {p} other words come here"] for p in prompts]


def test_a_round_keeps_only_what_is_new(spark):
    seeds = spark.createDataFrame([("en", "cats"), ("en", "dogs")], "language string, topic string")
    kept = spark.createDataFrame([("en", "cats one two three four")], "language string, text string")
    out = rounds.new_paragraphs(seeds, kept, F.col("topic"), 2, Numbered).collect()
    texts = {r.text for r in out}
    assert "cats one two three four" not in texts and len(texts) == 1 + 0 or len(texts) == 2
    bt = rounds.back_translations(spark.createDataFrame([(1, "A sentence that is surely long enough to pass here. Tiny one."), (2, "x")], "id long, text string"), "id", F.lit(True), F.lit(True))
    assert {r.id: len(r.propositions) for r in bt.collect()} == {1: 1, 2: 0}


def test_sources(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"text": "a", "topic": "t"}\n{"text": "b"}\nbroken\n')
    rows = corpora.read_records(spark, str(path), corpora.PARAGRAPHS).collect()
    assert sorted((r.text or "", r.topic or "") for r in rows) == [("", ""), ("a", "t"), ("b", "")] and sum(r._corrupt_record is not None for r in rows) == 1
    corpora.append_records(spark.createDataFrame([("ñ",)], "text string"), str(tmp_path / "out"))
    corpora.append_records(spark.createDataFrame([("x",)], "text string"), str(tmp_path / "out"))
    assert corpora.read_records(spark, str(tmp_path / "out"), corpora.PARAGRAPHS).count() == 2
    (tmp_path / "t.txt").write_text(" one \n\ntwo\n")
    assert [r.topic for r in corpora.read_topics(spark, str(tmp_path / "t.txt")).collect()] == ["one", "two"]
    np.arange(12, dtype="<f4").tofile(tmp_path / "v.bin")
    assert [(r.row_id, r.embedding) for r in corpora.read_vectors(spark, str(tmp_path / "v.bin"), 4).orderBy("row_id").collect()][1] == (1, [4.0, 5.0, 6.0, 7.0])
    run = tmp_path / "runs" / "Basque_to_English_0_shot_seed_122_llm_vanilla_0_0_0"
    run.mkdir(parents=True)
    (run / "translate_0.jsonl").write_text(json.dumps({"sentence": "s", "translation": "t"}) + "\n")
    bad = tmp_path / "runs" / f"{run.name} copy"
    bad.mkdir()
    (bad / "translate_0.jsonl").write_text(json.dumps({"sentence": "s", "translation": "u"}) + "\n")
    got = corpora.read_runs(spark, str(tmp_path / "runs" / "*" / "*.jsonl")).collect()
    assert [(r.src, r.tgt, r.k, r.seed, r.divide, r.merge, r.breadth, r.depth, r.refine, r.translation) for r in got] == [("Basque", "English", 0, 122, "llm", "vanilla", 0, 0, 0, "t")]


def test_stream_of_candidates_keeps_each_text_once(spark, tmp_path):
    from corpusloom.streaming.ingest import deduplicated_stream

    src, out = tmp_path / "in", tmp_path / "kept"
    src.mkdir()
    for n, texts in enumerate((["a", "b", "a"], ["b", "c"])):
        (src / f"{n}.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in texts))
        q = deduplicated_stream(spark, str(src), str(out), str(tmp_path / "state"))
        q.processAllAvailable()
        q.stop()
    assert sorted(r.text for r in spark.read.parquet(str(out)).collect()) == ["a", "b", "c"]


def _shuffled(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_near_pairs_of_many_cells_and_few_bytes(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choices(words, k=rng.randint(3, 160)) for _ in range(60)]
    near = [(i, "gh"[i % 2], [w if rng.random() < 0.88 else "z" for w in base[i % 60]] if i >= 60 else base[i]) for i in range(240)]
    rows = near + [(i + 1000, g, t) for i, g, t in near[:40]]  # copies
    df = spark.createDataFrame(rows, "doc_id long, g string, t array<string>").repartition(3)
    f = lambda a, b: 2 * lcs(a, b) / (len(a) + len(b))
    want = {(i, j, round(f(a, b), 6)) for i, g, a in rows for j, h, b in rows if i < j and g == h and f(a, b) > 0.7}
    assert {(r.a, r.b, r.f) for r in SIM.near_pairs(df, "t", 0.7, "g").collect()} == want
    for name, value in (("CELL_TEXTS", 40), ("CELL_ENTRIES", 400), ("BUCKET_PAIRS", 60), ("MET", 50), ("SIGNED", 7)):
        monkeypatch.setattr(SIM, name, value)
    assert {(r.a, r.b, r.f) for r in SIM.near_pairs(df, "t", 0.7, "g").collect()} == want
    heads = {}
    for i, g, t in rows:
        heads.setdefault((g, tuple(t)), i)
    own = {i: heads[g, tuple(t)] for i, g, t in rows}
    classes = {(a, b, s) for a, b, s in want if own[a] == a and own[b] == b} | {(h, i, 1.0) for i, h in own.items() if h != i}
    assert {(r.a, r.b, r.f) for r in SIM.near_classes(df, "t", 0.7, "g").collect()} == classes


def test_pairs_that_share_only_frequent_tokens_are_never_shuffled(spark):
    rng = random.Random(6)
    rows = [(i, "g", rng.choices([f"w{k}" for k in range(300)], k=120)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, g string, t array<string>")
    before = _shuffled(spark)
    assert SIM.greedy_unlike(df, "t", 0.7, "g").count() == len(rows)
    assert _shuffled(spark) - before < 4 * sum(len(w) + 1 for _, _, t in rows for w in t)


def test_a_round_drops_equal_rows_even_without_tokens(spark):
    class Same(I.EchoBackend):
        def generate(self, prompts, sampling):
            return [["1. ¿¿¿ ¡¡¡ ñññ éééé àààà\n2. one two three four five"] for _ in prompts]

    seeds = spark.createDataFrame([("en", "cats"), ("en", "dogs")], "language string, topic string")
    for kept, left in (("¿¿¿ ¡¡¡ ñññ éééé àààà", "one two three four five"), ("one two three four five", "¿¿¿ ¡¡¡ ñññ éééé àààà")):
        out = rounds.new_paragraphs(seeds, spark.createDataFrame([("en", kept)], "language string, text string"), F.col("topic"), 2, Same).collect()
        assert [(r.topic, r.text) for r in out] == [("cats", left)]


def test_a_round_shuffles_little_of_what_is_kept(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=120)) for _ in range(1200)]
    kept = spark.createDataFrame([("en", t) for t in texts], "language string, text string")
    seeds = spark.createDataFrame([("en", "cats"), ("en", "dogs")], "language string, topic string")
    before = _shuffled(spark)
    assert len(rounds.new_paragraphs(seeds, kept, F.col("topic"), 2, Numbered).collect()) >= 2
    assert _shuffled(spark) - before < 4 * sum(map(len, texts))
