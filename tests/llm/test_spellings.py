import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm.spellings import count_words, near_words, numbered_words, spelling_forms
from corpusloom.llm.word_automata import Automaton
from tests.llm.helpers import SCHEMA, frame, hard_rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(rows, least=7, drop=31):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if drop and h % drop == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_forms(words, ratio=10):
    out, forms = {}, {}
    for w, n in words.items():
        close = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = close[0][1] if close and -close[0][0] >= ratio * n else None
        forms[w] = form
        out[w] = (form, n, len(close), words[form] if form else None)
    for w, (form, n, k, m) in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (form, root, n, k, m)
    return out


def text_rows(seed=1):
    rng = random.Random(seed)
    base = ["election", "elections", "électron", "Ñandúes", "straßenbahn", "abcdefg", "naïveté" * 3, "aaaaaaaa", "aaaaaaaaa", "zzzzzzz", "ÀÉÎÕÜÿ÷×", "w" * 300]
    rows = [(r[0], r[1]) for r in hard_rows(seed)]
    for i in range(100, 160):
        own = []
        for w in rng.choices(base, [40, 30, 20, 9, 9, 9, 5, 9, 5, 1, 5, 2], k=120):
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "é", "q", w[k] * 2]) + w[k + 1 :]
            own.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "-1-", "漢"]).join(own)))
    return rows


def test_counts_and_forms(spark):
    rows = text_rows()
    counted = count_words(frame(spark, rows), drop_one_in=31)
    want = brute_words(rows)
    assert {r.word: r.n for r in counted.collect()} == want
    twice = {w: n for w, n in want.items() if n >= 2}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_forms(counted.where("n >= 2"), ratio=10).collect()}
    assert got == brute_forms(twice)
    assert any(r[0] and r[0] != r[1] for r in got.values())


def test_crowded_halves_are_refined(spark):
    rng = random.Random(3)
    words = {"prefixed" + "".join(rng.choices("abc", k=rng.choice([3, 4, 5]))) for _ in range(300)} | {"".join(rng.choices("ab", k=7)) for _ in range(60)}
    words |= {"".join(rng.choices("ab", k=4)) + "suffixed" for _ in range(60)}
    table = numbered_words(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).persist()
    ids = {r.id: r.word for r in table.collect()}
    assert [ids[i] for i in range(len(ids))] == sorted(words)
    want = Counter((a, b) for a in words for b in words if near(a, b))
    for hot in (1 << 16, 20, 3):
        assert Counter((ids[r.id], ids[r.near]) for r in near_words(table, hot).collect()) == want


def test_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling_forms(count_words(none)).count() == 0
    rows = text_rows(4)
    docs = frame(spark, rows).selectExpr("*", "1 as word", "2 as n", "3 as `a.b`", "4 as TEXT", "5 as c0")
    assert {r.word: r.n for r in count_words(docs).collect()} == brute_words(rows, drop=0)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=40))
def test_automaton_numbers_words_and_completes_with_one_error(words):
    rows = np.unique(np.array([w.encode("latin-1") for w in words], "S"))
    matrix, sizes = rows.view(np.uint8).reshape(len(rows), -1), np.char.str_len(rows).astype(np.int64)
    auto = Automaton.build(matrix, sizes)
    state, number = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for j in range(matrix.shape[1]):
        on = sizes > j
        ok, place = auto.step(state[on], matrix[on, j])
        assert ok.all()
        state[on], number[on] = auto.targets[place], number[on] + auto.skips[place]
    assert auto.final[state].all() and number.tolist() == list(range(len(rows)))
    languages = {}  # minimal: no two states accept the same words
    for s in range(len(auto.final) - 1, -1, -1):
        languages[s] = None

    def accepts(s):
        if languages[s] is None:
            edges = range(auto.first[s], auto.first[s + 1])
            languages[s] = (bool(auto.final[s]), tuple((int(auto.edges[e]) & 255, accepts(int(auto.targets[e]))) for e in edges))
        return languages[s]

    assert len({accepts(s) for s in range(len(auto.final))}) == len(auto.final)
    query, found = auto.one_error(matrix, sizes, sizes * 0, sizes)
    plain = [w.decode("latin-1") for w in rows]
    want = {(i, k) for i, a in enumerate(plain) for k, b in enumerate(plain) if near(a, b) and len(a) >= len(b)}
    assert set(zip(query.tolist(), found.tolist(), strict=True)) == want
