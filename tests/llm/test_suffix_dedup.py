import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.run_index import RunIndex, repeated_starts
from corpusloom.llm.suffix_dedup import remove_repeats, repeated_spans
from tests.llm.helpers import SCHEMA, frame, hard_rows, prose


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), st.integers(2, 9))
def test_index_finds_exactly_the_repeated_strings(strings, length):
    seen = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
    want = [[i for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1] for s in strings]
    assert [x.tolist() for x in repeated_starts(strings, length)] == want


def test_runs_are_fewer_in_repetitive_text():
    rng = random.Random(1)
    one = bytes(rng.choices(b"abcdef", k=400))
    many = np.frombuffer(b"\xff".join([one] * 20), np.uint8)
    assert len(RunIndex.build(many).symbols) < 2 * len(RunIndex.build(np.frombuffer(one, np.uint8)).symbols)


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        cover = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[: len(t)] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_with_passages():
    rng = random.Random(5)
    passage = prose(rng, 60)
    rows = hard_rows(2)
    for i in range(50, 60):
        a, b = prose(rng, 40), prose(rng, 40)
        cut = rng.randrange(len(passage) - 230)
        rows.append((i, a + passage[cut : cut + 220 + rng.randrange(10)] + b))
    rows.append((70, "ñ" * 150 + passage + "ñ" * 150))
    return rows


def test_matches_brute_force(spark):
    rows = rows_with_passages()
    got = repeated_spans(frame(spark, rows)).collect()
    want = Counter((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 200), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_removal_changes_only_texts(spark):
    rows = [r for r in rows_with_passages() if r[0] is not None]
    docs = frame(spark, rows).withColumnRenamed("lang", "key")
    out = remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[1].text is None and by_id[6].text == "" and by_id[6].n_chars == 0
    assert by_id[20].text == dict(rows)[20]
    again = repeated_spans(out.where("doc_id between 50 and 59")).collect()
    assert all(r.n_removed == 0 for r in again)


def test_empty_table(spark):
    assert repeated_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_minimizers_are_counted_window_by_window(spark):
    rows = rows_with_passages()
    got = repeated_spans(frame(spark, rows), hot_bytes=0).collect()
    want = Counter((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 200), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_long_texts_are_looked_at_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    body, passage = prose(rng, 3000), prose(rng, 100)
    rows = [(1, body + passage + body[:5000]), (2, "x" + passage), (3, prose(rng, 300)), (4, body[8000:9000])]
    import corpusloom.llm.suffix_dedup as module

    data = np.frombuffer(rows[0][1].encode(), np.uint8)
    monkeypatch.setattr(module, "PIECE", 1000)
    pieces = list(module._pieces(np.array([0, len(data)]), 200))
    starts = [s for _, _, lo, hi in pieces for s in range(lo, hi - 200 + 1)]
    assert starts == list(range(len(data) - 200 + 1))
    got = repeated_spans(frame(spark, rows)).collect()
    want = Counter((i, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], 200), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_columns_may_have_any_names(spark):
    rows = [r for r in rows_with_passages() if r[0] is not None]
    docs = frame(spark, rows)
    named = docs.selectExpr("*", "1 as _id", "2 as _mark", "3 as _kept", "4 as `a.b`", "5 as mark", "6 as c0", "7 as sid")
    out = remove_repeats(named)
    assert out.columns == named.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((r.doc_id, r.text) for r in remove_repeats(docs).collect())
    assert repeated_spans(named).count() == len(rows)
