import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from corpusloom.llm import attention, lm_scores, store
from corpusloom.llm.lm_scores import score_texts
from corpusloom.llm.toxicity import DECAY, SCALE, TOP, Model, _subsequences, fit_toxicity, score_toxicity, train, units
from corpusloom.llm.words import buffers
from tests.llm.helpers import SCHEMA, frame, hard_rows, prose


def test_gradient_is_right():
    rng = np.random.default_rng(0)
    upto = np.array([0, 5, 40, 40, 71])
    stream = rng.integers(1, attention.SLOTS, 71)
    y, opens, _ = attention.to_blocks(stream, upto)
    rows = np.arange(len(y))
    flat = attention.start(np.bincount(stream, minlength=attention.SLOTS)).astype(np.float64)
    loss, g = attention.gradient(flat, y, opens, rows)
    assert loss == pytest.approx(-attention.score(flat.astype(np.float32), y, opens).sum() / (y >= 0).sum(), rel=1e-4)
    at = 0
    for shape in attention.SHAPES.values():
        n = int(np.prod(shape))
        j = at + int(np.abs(g[at : at + n]).argmax())
        step = np.zeros_like(flat)
        step[j] = 1e-5
        slope = (attention.gradient(flat + step, y, opens, rows)[0] - attention.gradient(flat - step, y, opens, rows)[0]) / 2e-5
        assert slope == pytest.approx(g[j], rel=1e-3, abs=1e-9)
        at += n


def test_windows_are_causal_and_scored_once():
    rng = np.random.default_rng(1)
    stream = rng.integers(1, attention.SLOTS, 100)
    flat = attention.start(np.bincount(stream, minlength=attention.SLOTS))

    def scores(s):
        y, opens, _ = attention.to_blocks(s, np.array([0, len(s)]))
        assert (y >= 0).sum() == len(s) + 1
        return attention.score(flat, y, opens).ravel()[: len(s)]

    a = scores(stream)
    changed = stream.copy()
    changed[60:] = 7
    b = scores(changed)
    assert np.allclose(a[:60], b[:60], atol=1e-5) and not np.allclose(a[61:], b[61:])
    far = stream.copy()
    far[10] = 7  # further back than the symbols of the residual: only attention sees it
    c = scores(far)
    assert abs(c[10 + attention.LAGS + 2 : 28] - a[10 + attention.LAGS + 2 : 28]).max() > 1e-6


def test_blocks_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, attention.SLOTS, n) for n in (0, 1, 15, 16, 17, 90)]
    flat = attention.start(np.ones(attention.SLOTS))
    y, opens, first = attention.to_blocks(np.concatenate(texts), np.cumsum([0, *map(len, texts)]))
    together = np.add.reduceat(attention.score(flat, y, opens).sum(axis=1), first[:-1])
    alone = [attention.score(flat, *attention.to_blocks(t, np.array([0, len(t)]))[:2]).sum() for t in texts]
    assert together == pytest.approx(alone, rel=1e-5)
    y, _, _ = attention.to_blocks(texts[3], np.array([0, 16]), np.array([False]))
    assert (y >= 0).sum() == 16  # a text that goes on has no end


def test_probabilities_of_one_step_add_up():
    flat = attention.start(np.ones(attention.SLOTS))
    total = 0.0
    for last in range(0, attention.SLOTS):
        y, opens, _ = attention.to_blocks(np.array([5, last]), np.array([0, 2]))
        total += math.exp(attention.score(flat, y, opens).ravel()[1])
    assert total == pytest.approx(1.0, abs=1e-3)


def lm_rows():
    rng = random.Random(9)
    return hard_rows() + [(i, prose(rng, 60)) for i in range(100, 260)]


def test_counts_and_base_are_exact(spark):
    rows = [(i, t) for i, t in lm_rows() if i is not None]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = ~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    got = score_texts(frame(spark, rows), train, blocks=30_000).collect()
    count = Counter()
    for i, t in rows:
        if not held(i):
            count.update((t or "").encode().lower().split())
            count["end"] += 1
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = (t or "").encode().lower().split() + ["end"]
        want[i, len(w), sum(count[x] > 0 for x in w), round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), 4)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def linked_prose(n):
    """Texts of two topics in which a word has three followers; base_score cannot know them."""
    rng = random.Random(21)
    out = []
    vocabulary = [[w for w in prose(rng, 120).split()] for _ in range(2)]
    for i in range(n):
        words, at = vocabulary[i % 2], rng.randrange(120)
        text = []
        for _ in range(rng.randint(30, 90)):
            text.append(words[at])
            at = (at * 7 + rng.choice([1, 5, 11])) % 120
        out.append((i, " ".join(text)))
    return out


def test_the_model_beats_the_base_on_held_out_texts(spark):
    rows = linked_prose(500)
    got = score_texts(frame(spark, rows), F.col("doc_id") % 7 != 2).where("doc_id % 7 = 2").collect()
    assert len(got) == 72
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)  # both are negative
    assert sum(r.score > r.base_score for r in got) > 65


def test_segments_cover_every_training_word_and_counts_are_whole():
    ranks = lm_scores.read_ranks(lm_scores.DEFAULT_RANKS)
    enc, rng = lm_scores.encoder(ranks), random.Random(4)
    texts = [prose(rng, rng.randrange(400)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(300)), "train": [i % 3 > 0 for i in range(300)], "text": texts})

    def parts(share, workers):
        return [r for b in lm_scores._chunker(2, workers, share, ranks)(iter([batch])) for r in b.to_pylist()]

    def learned(rows):
        out = Counter()
        for r in rows:
            if r["kind"] == 2:
                ids, bounds = np.frombuffer(zstandard.decompress(r["ids"]), np.uint16), np.frombuffer(r["bounds"], np.int64)
                assert set((np.frombuffer(r["hashes"], np.uint64) % 3).tolist()) == {r["shard"]}
                out.update((tuple(ids[a:b].tolist()), e) for a, b, e in zip(bounds[:-1], bounds[1:], np.frombuffer(r["ends"], bool).tolist(), strict=True))
        return out

    want, whole = Counter(), Counter()
    for n, t in enumerate(texts):
        words = [enc.encode_ordinary(" " + w) for w in t.lower().split()]
        if n % 3:
            whole.update(i for w in words for i in w)
            for lo in range(0, max(1, len(words)), lm_scores.SEGMENT):
                part = words[max(0, lo - lm_scores.BEFORE) : lo + lm_scores.SEGMENT]
                want[tuple(i for w in part for i in w), lo + lm_scores.SEGMENT >= len(words)] += 1
    every, some = parts(1.0, 3), learned(parts(0.3, 3))
    assert learned(every) == want
    assert not some - want and 0.2 < some.total() / want.total() < 0.4
    counts = Counter()
    for r in every:
        if r["kind"] == 3:
            counts.update(dict(zip(np.frombuffer(r["ids"], np.int32).tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True)))
    assert +counts == whole


def test_words_are_spelled_one_by_one_or_together():
    ranks = lm_scores.read_ranks(lm_scores.DEFAULT_RANKS)
    enc = lm_scores.encoder(ranks)
    opening = np.zeros(max(ranks.values()) + 1, bool)
    opening[[i for b, i in ranks.items() if b[:1] == b" "]] = True
    words = ["the", "don't", "42!", "...", "éñ漢🙂", "a\u00a0b", "\u2003x", "\u3000", "z\u2003", "x"]
    raw = [w.encode() for w in words]
    ids, first = lm_scores._spell(b"".join(b" " + r for r in raw), np.array([len(r) for r in raw]), enc, opening)
    by_word = [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert [enc.decode_bytes(x) for x in by_word] == [b" " + r for r in raw]
    assert by_word[:5] == [enc.encode_ordinary(" " + w) for w in words[:5]]


def test_scores_do_not_depend_on_partitions(spark):
    rows = [r for r in lm_rows() if r[0] is not None]
    train = F.col("doc_id") % 7 != 2
    docs = frame(spark, rows)
    odd = docs.selectExpr("*", "1 as train", "2 as chunk", "3 as `a.b`").repartition(7, "text")
    one, seven = (sorted((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in score_texts(d, train, blocks=6000).collect()) for d in (docs.coalesce(1), odd))
    assert [r[:3] for r in one] == [r[:3] for r in seven]
    assert [r[3] for r in one] == pytest.approx([r[3] for r in seven]) and [r[4] for r in one] == pytest.approx([r[4] for r in seven], rel=1e-3)


def test_training_uses_every_block(monkeypatch):
    rng = np.random.default_rng(2)
    drawn = []
    monkeypatch.setattr(attention, "train", lambda flat, y, opens, turn, rate: (drawn.append((len(y), turn)), (flat, 0.0))[1])
    flat, keys = attention.start(np.ones(attention.SLOTS)), np.arange(40, dtype=np.uint64)
    symbols = lm_scores.Symbols(np.arange(1001), np.arange(1000) % 900 + 1)
    ids, press = rng.integers(0, 1000, 40 * 50).astype(np.uint16), zstandard.ZstdCompressor()
    rows = pa.table({"shard": [0], "hashes": [keys.tobytes()], "ids": [press.compress(ids.tobytes())], "bounds": [np.arange(0, 2001, 50).astype(np.int64).tobytes()], "ends": [np.ones(40, bool).tobytes()]})
    for blocks in (0, 100):
        drawn.clear()
        for r in range(3):
            lm_scores._local_steps(flat, symbols, r, 3, blocks, 0.01)(rows)
        assert {n for n, _ in drawn} == {160} and set(np.concatenate([t for _, t in drawn]).tolist()) == set(range(160))
        assert sum(len(t) for _, t in drawn) == max(160, 3 * blocks)


def test_lm_without_rows_or_training_rows(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    r = score_texts(frame(spark, [(1, "a b"), (2, None)]), F.lit(False)).orderBy("doc_id").collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in r] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]


def toxic_rows(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = prose(rng, 40).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(["grumblefoot", "snorkwit", "zibblehead"]) + rng.choice(["", "s", "er"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = toxic_rows(1, 500)
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(docs, marks.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r._score for r in score_toxicity(docs, model).collect()}
    held = [(got[i], t) for i, t in labels if i % 4 == 2]
    assert sum((s >= 0.3) == bool(t) for s, t in held) / len(held) > 0.97
    spread = [(1000, "well g-r-u-m-b-l-e-f-o-o-t indeed"), (1001, "you s n o r k w i t there"), (1002, "calm words and nothing more"), (1003, None), (1004, "")]
    odd = {r.doc_id: r._score for r in score_toxicity(frame(spark, spread), model).collect()}
    assert odd[1001] > 0.3 and odd[1000] > odd[1002] and odd[1003] == odd[1004] < 0.3


def test_toxicity_edge_cases(spark):
    rows, labels = toxic_rows(2, 40)
    docs = frame(spark, rows).withColumnRenamed("lang", "score")
    one_class = spark.createDataFrame([(1, 0), (1, None)], "doc_id long, toxic int")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    with pytest.raises(ValueError, match="no text labelled toxic"):
        fit_toxicity(docs, marks, text_bytes=0)
    first = min((i for i, _ in labels), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())  # a long labelled text ends nothing
    long = frame(spark, [(i, t + " calm" * 3000 if i == first else t) for i, t in rows])
    rest = fit_toxicity(docs, marks.where(F.col("doc_id") != first))
    assert np.array_equal(fit_toxicity(long, marks, text_bytes=2000).table, rest.table) and rest.slopes.any()
    out = score_toxicity(docs, fit_toxicity(docs, one_class))
    assert out.columns == [*docs.columns, "_score"] and max(r._score for r in out.collect()) < 1e-6
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(frame(spark, hard_rows()), fit_toxicity(docs, none)).count() == len(hard_rows())
    assert score_toxicity(spark.createDataFrame([], SCHEMA), fit_toxicity(docs, none)).count() == 0


def test_folded_table_gives_the_kernel_sum():
    rng = random.Random(11)
    marks = ["".join(rng.choices("abcd", k=rng.randint(2, 6))).encode() for _ in range(5)]
    share = [rng.uniform(-1, 1) for _ in marks]
    symbols = np.zeros(256, np.int32)
    symbols[list(b"abcd")] = np.arange(2, 6)

    def kernel(a, b):  # by definition: common subsequences of three symbols, a start mark in front
        def spans(s):
            s, out = b"^" + s, Counter()
            for k in itertools.combinations(range(len(s)), 3):
                out[tuple(s[i] for i in k)] += DECAY ** (k[2] - k[0] + 1)
            return out, SCALE[len(s) - 1]

        (x, m), (y, n) = spans(a), spans(b)
        return sum(x[t] * y[t] for t in x) / m / n

    table = np.zeros(6**3, np.float32)
    for w, c in zip(marks, share, strict=True):
        for cell, value in _subsequences(w, symbols, 6).items():
            table[cell] += c * value / SCALE[len(w)]
    texts = [" ".join("".join(rng.choices("abcd", k=rng.randint(1, 9))) for _ in range(6)) for _ in range(20)]
    bags = units(*buffers(pa.array(texts)))
    whole = np.nonzero(bags.fresh)[0]
    got = Model(symbols, table, 0.25, np.zeros(TOP), 0.0).decide(bags, whole)
    raw = bags.data.tobytes()
    want = [0.25 + sum(c * kernel(raw[s : s + n], w) for w, c in zip(marks, share, strict=True)) for s, n in zip(bags.starts[whole].tolist(), bags.sizes[whole].tolist(), strict=True)]
    assert got == pytest.approx(want, abs=1e-4)


def test_toxicity_needs_several_units_and_reads_every_byte(spark):
    rng = random.Random(12)
    stems = ["плохойй", "дурнойй", "гадкийй"]
    rows, labels = [], []
    for i in range(300):
        words = prose(rng, 30).split()
        if i % 5 == 0:
            for k in range(3):
                words[rng.randrange(30)] = stems[(i + k) % 3] + rng.choice(["", "а", "ом"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    odd = docs.selectExpr("*", "1 as _score", "2 as `a.b`", "3 as turn", "4 as upto")
    model = fit_toxicity(odd, marks.where("doc_id % 4 <> 2").union(marks))  # repeated labels
    out = score_toxicity(odd.union(odd.where("doc_id < 3")), model, "likely")
    assert out.columns == [*odd.columns, "likely"]
    got = out.collect()
    assert len(got) == 303 and len({(r.doc_id, r.likely) for r in got}) == 300
    assert sum((r.likely >= 0.3) == (r.doc_id % 5 == 0) for r in got if r.doc_id % 4 == 2) / sum(r.doc_id % 4 == 2 for r in got) > 0.95


def test_toxicity_learns_alike_twice():
    rows, labels = toxic_rows(3, 120)
    texts, marks = [t for _, t in rows], np.array([bool(x) for _, x in labels])
    a, b = train(texts, marks), train(texts, marks)
    assert (a.table == b.table).all() and (a.slopes == b.slopes).all() and (a.slopes >= 0).all()


def test_every_segment_of_a_large_corpus_is_learned_from(spark, monkeypatch):
    texts, seen = ["one two three four " * 45_000] * 31, []  # over 24 MB

    def counted(segments, *args):
        seen.append(sum(len(r.hashes) // 8 for r in segments.select("hashes").collect()))
        raise StopIteration

    monkeypatch.setattr(lm_scores, "train_attention", counted)
    with pytest.raises(StopIteration):
        score_texts(frame(spark, list(enumerate(texts))), F.lit(True))
    assert seen == [31 * -(-4 * 45_000 // lm_scores.SEGMENT)]


def test_a_large_share_takes_as_many_steps_as_half_of_it(monkeypatch):
    steps = []
    monkeypatch.setattr(attention, "gradient", lambda flat, y, opens, rows: (steps.append(len(rows)), (0.0, np.zeros_like(flat)))[1])
    flat = attention.start(np.ones(attention.SLOTS))
    for n, most in ((540 * 192, 540), (540 * 384, 540), (350 * 20, 350)):
        steps.clear()
        attention.train(flat, np.zeros((n, 1)), np.zeros(n, bool), np.arange(n), 0.01)
        assert sum(steps) == n and len(steps) == most


def test_gradient_of_far_logits_is_finite():
    y, opens, _ = attention.to_blocks(np.arange(1, 60), np.array([0, 59]))
    flat = attention.start(np.ones(attention.SLOTS))
    plain = attention.gradient(flat, y, opens, np.arange(len(y)))
    for name, by in (("bc", 500), ("bk", -500), ("far", 500)):  # all alike, so probabilities stay as they are
        moved = flat.copy()
        attention.unpack(moved)[name][:] += by
        loss, g = attention.gradient(moved, y, opens, np.arange(len(y)))
        assert loss == pytest.approx(plain[0], rel=1e-3) and g == pytest.approx(plain[1], abs=1e-4)


def test_scoring_keeps_no_files_of_words_and_segments(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(store, "shared_dir", lambda spark: str(tmp_path))
    rows = [(i, t) for i, t in lm_rows() if i is not None]
    got = score_texts(frame(spark, rows), F.lit(True), blocks=600)
    assert got.count() == len(rows)
    assert {p.parent.name for p in tmp_path.rglob("*.parquet")} & {"kind=0", "kind=1", "kind=2", "kind=3"} == {"kind=0", "kind=3"}
