from collections import defaultdict

import numpy as np

from corpusloom.llm.setsketch import keep_one, merge_registers, near_duplicates, registers, similarity_likelihood
from corpusloom.llm.words import stream
from tests.llm.helpers import SCHEMA, frame, hard_rows, prose


def brute(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                joint = len(sets[a] & sets[b])
                if 100 * joint >= percent * (len(sets[a]) + len(sets[b]) - joint):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_matches_brute_force(spark):
    rows = [r for r in hard_rows() if r[0] is not None]
    got = near_duplicates(frame(spark, rows), 3, 85).collect()
    assert len(got) == len(rows)
    want = brute(dict(rows).items(), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_chain_of_edits_is_one_class(spark):
    import random

    rng = random.Random(3)
    words = prose(rng, 150).split()
    rows = []
    for i in range(12):  # each differs a little from the one before, the ends differ a lot
        rows.append((i, " ".join(words)))
        words[10 * i + 5] = f"edit{i}"
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), 3, 85).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 3, 85).items()}
    assert set(got.values()) == {0}


def test_star_of_edits_with_small_blocks(spark):
    import random

    rng = random.Random(4)
    base = prose(rng, 200).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(frame(spark, rows), 3, 85, block=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_empty_table_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, 2, 3)], "doc_id long, text string, node long, component long, n long")
    assert near_duplicates(docs).first().component_id == 1
    assert keep_one(docs).columns == docs.columns


def test_keep_one_keeps_one_of_each_class(spark):
    rows = hard_rows()
    out = keep_one(frame(spark, rows)).collect()
    ids = [r.doc_id for r in out]
    assert 6 in ids and not {7, 8, 11} & set(ids) and None in ids and {1, 2, 3} <= set(ids)
    twice = keep_one(frame(spark, [(5, "a b c d e f"), (5, "a b c d e f")])).count()
    assert twice == 1


def test_one_id_with_two_texts_and_texts_without_id(spark):
    import random

    rng = random.Random(8)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(5, a), (5, b), (9, a + " more"), (11, b + " more"), (None, c), (None, c + " more"), (12, c + " less")]
    got = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows), 3, 85).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (11, 5, False), (0, 12, True), (0, 12, True), (12, 12, True)], key=str)  # rows without id stay
    kept = keep_one(frame(spark, [(3, b + " first"), *rows]), 3, 85)
    assert sorted(r.text for r in kept.collect()) == sorted([b + " first", a, c, c + " more", c + " less"])


def test_registers_merge_and_likelihood_finds_the_similarity():
    salts = stream(23, 512)
    items = stream(99, 900)
    a, b = items[:600], items[300:]
    assert (merge_registers(registers(a, salts), registers(b, salts)) == registers(items, salts)).all()
    grid = np.linspace(0, 1, 101)
    ka, kb = registers(a, salts)[None], registers(b, salts)[None]
    ll = similarity_likelihood(ka, kb, np.array([600.0]), np.array([600.0]), grid)
    assert abs(grid[ll[0].argmax()] - 1 / 3) < 0.1


def test_no_pair_growth_for_equal_sets(spark):
    rows = [(i, "same words in every single row here") for i in range(500)]
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}
    assert defaultdict(int, {True: 1})[True] == sum(r.kept for r in got)


def test_very_long_texts_and_odd_names(spark):
    import random

    from corpusloom.llm import setsketch

    rng = random.Random(8)
    sets = np.unique(np.array([rng.getrandbits(64) for _ in range(3 * setsketch.STEP + 7)], np.uint64))
    parts = [registers(p, stream(23, 64)) for p in np.array_split(sets, 5)]
    whole = registers(sets, stream(23, 64))
    for p in parts[1:]:
        parts[0] = merge_registers(parts[0], p)
    assert (parts[0] == whole).all()
    words = prose(rng, 40_000).split()
    edited = [w if i % 400 else "x" for i, w in enumerate(words)]
    rows = [(5, " ".join(words)), (6, " ".join(edited)), (7, "short text of six words here")]
    odd = frame(spark, rows).selectExpr("*", "1 as kept_id", "2 as kept_rows", "3 as `a.b`", "4 as _id", "5 as node")
    assert {r.doc_id: r.component_id for r in near_duplicates(odd).collect()} == {5: 5, 6: 5, 7: 7}
    out = keep_one(odd)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == [5, 7]


def test_components_of_a_long_chain_and_of_nothing(spark):
    from corpusloom.llm.components import connected_components

    chain = spark.range(300).selectExpr("id as u", "id + 1 as v", "1 as w").union(spark.createDataFrame([(7, 7, 1), (9, 8, 1), (None, 3, 1)], "u long, v long, w int"))
    assert {(r.node, r.component) for r in connected_components(chain).collect()} == {(i, 0) for i in range(301)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_classes_with_equal_nodes_are_told_apart(spark):
    rows = [r for r in hard_rows(4) if r[0] is not None]
    got = near_duplicates(frame(spark, rows), 3, 85, node_bytes=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(dict(rows).items(), 3, 85) and len(got) == len(rows)
