import itertools
import math
import random
from collections import Counter

import pyarrow as pa
from tokenizers import models

from corpusloom.llm import sampled_pieces
from corpusloom.llm.lattice import Lattice, Vocabulary, split_units
from corpusloom.llm.sampled_pieces import Codec, _sampler, sample_pieces
from corpusloom.llm.token_counts import count_tokens
from tests.llm.helpers import SCHEMA, frame, hard_rows, prose

V = Vocabulary.load()


def test_counts_equal_the_library(spark):
    rows = [r for r in hard_rows() if r[0] != 9] + [(90, "a  b   c\n\n d"), (91, "   "), (92, "\t\tq​"), (93, "▁▁x ▁"), (94, "word, word. (word)")]
    library = models.Unigram([("<unk>", -99.0)] + [(p, float(s)) for p, s in zip(V.pieces, V.scores, strict=True)] + [(f"<0x{b:02X}>", -500.0 - b) for b in range(256)], 0, True)
    got = Counter((r.doc_id, r.n_tokens) for r in count_tokens(frame(spark, rows)).collect())
    want = Counter((i, len(library.tokenize("▁" + t.replace(" ", "▁"))) if t else 0) for i, t in rows)
    assert got == want


def brute(unit, pieces, scores, unknown):
    """Best score and count; of equal scores the longest last piece."""
    best = [(0.0, 0)] + [None] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(end):
            s = scores.get(unit[start:end])
            n = 1
            if s is None and end - start == 1:
                s, n = unknown, len(unit[start:end].encode())
            if s is not None and (best[end] is None or best[start][0] + s > best[end][0]):
                best[end] = (best[start][0] + s, best[start][1] + n)
    return best[-1]


def test_ties_and_unknown_characters():
    import numpy as np

    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    rng = random.Random(3)
    for scores in ([-1.0, -1.0, -2.0, -2.0, -3.0, -1.0, -2.0], [-1.0] * 7, [-2.0, -1.0, -3.0, -3.0, -4.0, -1.0, -3.0]):
        v = Vocabulary(pieces, np.arange(7), np.array(scores), np.arange(10, 266))
        units = sorted({"".join(rng.choices("abé漢▁", k=rng.randint(1, 9))) for _ in range(200)})
        best, count = Lattice.build(units, v, v.automaton()).viterbi()
        for u, s, n in zip(units, best, count, strict=True):
            assert (s, n) == brute(u, pieces, dict(zip(pieces, scores, strict=True)), v.unknown)


def segmentations(unit):
    known = dict(zip(V.pieces, V.scores, strict=True))
    if not unit:
        return [()]
    return [(unit[:n], *rest) for n in range(1, len(unit) + 1) if unit[:n] in known for rest in segmentations(unit[n:])]


def test_sampling_without_replacement_has_the_right_distribution():
    n = 12000
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(["then on"] * n)], names=["doc_id", "text"])
    got = pa.Table.from_batches(list(_sampler(V, "doc_id", 2, 1.0, 0, True)(iter([batch])))).to_pandas()
    known, ids = dict(zip(V.pieces, V.scores, strict=True)), dict(zip(V.pieces, V.ids.tolist(), strict=True))
    paths = {tuple(ids[p] for p in a + b): math.exp(sum(known[p] for p in a + b)) for a in segmentations("▁then") for b in segmentations("▁on")}
    total = sum(paths.values())
    p = {k: v / total for k, v in paths.items()}
    first, second = got[got["sample"] == 1], got[got["sample"] == 2]
    top = sorted(p, key=lambda k: -p[k])[:3]
    seen = Counter(map(tuple, first.ids))
    for k in top:
        assert abs(seen[k] / n - p[k]) < 0.02
    both = Counter(zip(map(tuple, first.ids), map(tuple, second.ids), strict=True))
    for a, b in itertools.permutations(top, 2):
        assert abs(both[a, b] / n - p[a] * p[b] / (1 - p[a])) < 0.02
    assert all(abs(math.log(p[tuple(i)]) - x) < 1e-9 for i, x in zip(first.ids[:200], first.log_prob[:200], strict=True))
    # inclusion scores make weighted sums unbiased
    assert abs((2.718281828459045 ** got.log_prob / got.inclusion).sum() / n - 1) < 0.02


def test_all_segmentations_are_found_once(spark):
    rows = sample_pieces(frame(spark, [(1, "to")]), k=50, with_ids=True).collect()
    assert len(rows) == len({tuple(r.ids) for r in rows}) == len(segmentations("▁to"))
    assert all(r.inclusion == 1.0 for r in rows)
    assert [r.perturbed for r in sorted(rows, key=lambda r: r["sample"])] == sorted((r.perturbed for r in rows), reverse=True)


def test_round_trip_and_reruns(spark):
    docs = frame(spark, hard_rows())
    a = sample_pieces(docs, k=3, with_ids=True).collect()
    assert all(r.decoded for r in a)
    codec, text = Codec(V), dict(hard_rows())
    assert all(codec.decode(r.ids) == (text[r.doc_id] or "").replace("▁", " ") for r in a)
    key = lambda r: (r.doc_id is None, r.doc_id, r["sample"], r.ids_sha256)
    b = sample_pieces(docs.repartition(5), k=3).collect()
    assert sorted(map(key, a)) == sorted(map(key, b))
    empty = [r for r in a if r.doc_id in (1, 2)]
    assert [(r["sample"], r.n_pieces) for r in empty] == [(1, 0), (1, 0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert count_tokens(none).count() == sample_pieces(none).count() == 0
    assert split_units("") == []


def test_only_empty_texts_and_known_units(spark):
    rows = sample_pieces(frame(spark, [(1, ""), (2, None)]).coalesce(1), k=2).collect()
    assert sorted((r.doc_id, r["sample"], r.n_pieces, r.inclusion) for r in rows) == [(1, 1, 0, 1.0), (2, 1, 0, 1.0)]
    # units seen before, or forgotten, give the same samples
    run, texts = _sampler(V, "doc_id", 2, 1.0, 0, True), ["a to to b", "to", "to b c to", "\n", "c漢 漢 a"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], names=["doc_id", "text"])
    whole = {(r["doc_id"], r["sample"]): r["ids"] for b in run(iter([batch])) for r in b.to_pylist()}
    sampled_pieces._tables.clear()
    parts = {(r["doc_id"], r["sample"]): r["ids"] for i in (3, 1, 4, 0, 2) for b in run(iter([batch.slice(i, 1)])) for r in b.to_pylist()}
    assert whole == parts


def test_names_that_clash_and_long_texts(spark):
    rng = random.Random(3)
    rows = [(1, prose(rng, 30_000)), (2, "a b"), (2, "a b"), (None, "x"), (3, "")]
    docs = frame(spark, rows)
    odd = docs.selectExpr("*", "1 as sample", "2 as n_pieces", "3 as `a.b`", "4 as n_tokens", "5 as c0")
    for run in (lambda d: count_tokens(d), lambda d: sample_pieces(d, k=2)):
        a, b = run(docs).collect(), run(odd.repartition(3)).collect()
        assert sorted(map(str, a)) == sorted(map(str, b))
    assert all(r.decoded for r in sample_pieces(odd).collect())
