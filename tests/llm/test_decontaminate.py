import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.decontaminate import Benchmark, TrainingSuffixes, contaminated, longest_matches, mark_contaminated, without_contaminated
from tests.llm.helpers import SCHEMA, frame, hard_rows, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, length=10):
    out = Counter()
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, item in items:
            w = words(item)
            size = min(length, len(w))
            if size:
                windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
                at = [i for i in range(len(own) - size + 1) if tuple(own[i : i + size]) in windows]
                hit.update(k for i in at for k in range(i, i + size))
                if at and item_id is not None:
                    found.add(str(item_id))
        out[doc_id, len(own), len(hit), len(found), ",".join(sorted(found)), bool(hit)] += 1
    return out


def cases(seed=3):
    rng = random.Random(seed)
    rows = [(r[0], r[1]) for r in hard_rows(seed)]
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "one"), (23, "漢字🙂 ünï"), (None, prose(rng, 15)), (3, prose(rng, 12)), (3, items[3][1]), (30, items[1][1] + " tail")]
    for i, (_, text) in enumerate(items):
        if text:
            cut = rng.randrange(max(1, len(text.split()) - 9))
            rows.append((100 + i, prose(rng, 20) + " - " + text.upper().replace(" ", ", ") + "! " + prose(rng, 5)))
            rows.append((200 + i, prose(rng, 3) + " " + " ".join(text.split()[cut : cut + 10])))
    rows.append((300, " ".join(x[1] for x in items if x[1]) * 3))
    return rows, items


def result(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in df.collect())


def test_matches_brute_force(spark):
    rows, items = cases()
    got = contaminated(frame(spark, rows), spark.createDataFrame(items, ITEMS))
    assert result(got) == brute(rows, items)


@pytest.mark.parametrize(("block_words", "shard_words"), [(40, 1 << 20), (1 << 20, 50), (60, 1)])
def test_blocks_and_shards_do_not_matter(spark, block_words, shard_words):
    rows, items = cases(4)
    got = mark_contaminated(frame(spark, rows).select("doc_id", "text"), spark.createDataFrame(items, ITEMS), 10, block_words, shard_words)
    want = brute(rows, items)
    assert Counter((r.c0, r.n_words, sum(b - a for a, b in zip(r.los, r.his, strict=True)), len(r["items"]), ",".join(r["items"]), bool(r.los)) for r in got.collect()) == want


def test_removal_keeps_columns_of_any_names(spark):
    rows, items = cases()
    docs = frame(spark, rows).selectExpr("*", "1 as items", "2 as c0", "3 as `a.b`", "4 as TEXT", "5 as n_words")
    out = without_contaminated(docs, spark.createDataFrame(items, ITEMS).selectExpr("*", "1 as item"))
    assert out.columns == docs.columns
    bad = {k[0] for k in brute(rows, items) if k[-1]}
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(d for d, _ in rows if d not in bad)


def test_longest_matches(spark):
    rows, items = cases(5)
    got = {r.item_id: r for r in longest_matches(frame(spark, rows), spark.createDataFrame(items, ITEMS), shard_words=300).collect()}
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(words(text))
    for item_id in {i for i, _ in items if i is not None}:
        best = 0
        for _, text in (x for x in items if x[0] == item_id):
            w = words(text)
            for own in (t for many in texts.values() for t in many):
                joined = " " + " ".join(own) + " "
                for i in range(len(w)):
                    while i + best < len(w) and " " + " ".join(w[i : i + best + 1]) + " " in joined:
                        best += 1
        assert best == (got[str(item_id)].n_words if str(item_id) in got else 0)
        if best:
            r = got[str(item_id)]
            found = {tuple(t[r.doc_word : r.doc_word + best]) for t in texts[r.doc_id]}
            assert any(tuple(words(t)[r.item_word : r.item_word + best]) in found for i, t in items if i == item_id)


def test_empty_tables(spark):
    rows, items = cases()
    none = spark.createDataFrame([], ITEMS)
    assert contaminated(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, ITEMS)).count() == 0
    assert {r.contaminated for r in contaminated(frame(spark, rows), none).collect()} == {False}
    assert longest_matches(frame(spark, rows), none).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=4), st.lists(st.integers(0, 5), min_size=1, max_size=120), st.integers(1, 12))
def test_suffixes_find_all_places_of_a_window(items, shard, length):
    hashes = np.array([0, 11, 22, 33, 44, 55], np.uint64)
    b = Benchmark.build([(str(i), len(x), 0, hashes[x]) for i, x in enumerate(items)], length)
    ids = b.numbers(hashes[shard])
    found = TrainingSuffixes.build(ids, b.bits, b.per_key, b.least, b.deepest)
    lo, hi = found.places(b, b.first, b.sizes)
    got = {(int(p), w) for w in range(len(lo)) for p in found.order[lo[w] : hi[w]]}
    flat = {int(a): (i, int(p)) for a, i, p in zip(b.at, b.item, b.place, strict=True)}
    want = set()
    for w, (at, size) in enumerate(zip(b.first.tolist(), b.sizes.tolist(), strict=True)):
        i, p = flat[at]
        text = items[int(b.names[i])][p : p + size]
        want |= {(k, w) for k in range(len(shard) - size + 1) if shard[k : k + size] == text}
    assert got == want
    longest = TrainingSuffixes.build(ids, b.bits, b.per_key, 1, b.deepest).longest(b)
    for t, n in enumerate(longest.tolist()):
        own = items[int(b.names[b.item[t]])][int(b.place[t]) :]
        fits = [m for m in range(len(own) + 1) if any(shard[k : k + m] == own[:m] for k in range(len(shard) - m + 1))]
        assert n == max(fits)
