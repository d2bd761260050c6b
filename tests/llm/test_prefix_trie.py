import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm.prefix_trie import conversation_trie, list_digests, prefix_trie, prefixes, share_heads

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def in_order(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            said = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, said), (role, text)))
    return {c: [x for _, x in sorted(v)] for c, v in turns.items()}


def rebuilt(turns):
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, own in members.items():
        ids = ",".join(map(str, sorted(ends[p])))
        parent = min(members[p[:-1]]) if p else None
        out[min(own), len(p), parent, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ids.encode()).hexdigest()] += 1
    return out


def result(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def hard_turns(seed=2):
    rng = random.Random(seed)
    said = ["hello", "", None, "é漢🙂", "x" * 500, "ok", "ok "]
    rows = []
    for c in [*range(0, 12), 100, 105, 117, 150, 200, 203, 305, -7, -100, -101]:
        for t in range(rng.choice([1, 1, 2, 4, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(said)))
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "user", "eit"), (4, None, "user", "first"), (None, 1, "user", "no id"), (8, 5, None, None)]
    rows += [(400 + i, t, "user", f"step {t}") for i in range(3) for t in range(40 + i)]
    rng.shuffle(rows)
    return rows


def heads():
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, F.col("conv_id") - F.col("conv_id") % 100


@pytest.mark.parametrize("parts", [1, 7])
def test_matches_brute_force(spark, parts):
    rows = hard_turns()
    turns = prefixes(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    got = prefix_trie(*share_heads(turns, *heads(), most=5))
    assert result(got) == brute(rebuilt(in_order(rows)))


def test_plain_conversations_and_odd_columns(spark):
    rows = hard_turns(5)
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as k1", "3 as CONV_ID", "4 as `a.b`", "5 as n", "6 as c0")
    assert result(conversation_trie(table)) == brute(in_order(rows))


def test_one_conversation_over_many_tasks(spark):
    rows = [(7, t, "user", f"{t % 5}") for t in range(300)] + [(7, None, "user", "same")] * 40 + [(c, t, "user", f"{t % 5}") for c in (5, 9) for t in range(3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, SCHEMA)
        places = prefixes(table)
        assert [r.pos for r in places.where("conv_id = 7").orderBy("pos").collect()] == list(range(1, 341))
        assert result(conversation_trie(table)) == brute(in_order(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_digests_of_long_lists(spark, monkeypatch):
    ids = [(k, 0, i) for k in (1, 2) for i in range(-30000, 40000)] + [(3, 0, 5)]
    got = {r.k1: r.ends_sha256 for r in list_digests(spark.createDataFrame(ids, "k1 long, k2 long, conv_id long")).collect()}
    want = hashlib.sha256(",".join(map(str, range(-30000, 40000))).encode()).hexdigest()
    assert got == {1: want, 2: want, 3: hashlib.sha256(b"5").hexdigest()}


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_trie(none).count() == 0
    assert prefix_trie(*share_heads(prefixes(none), *heads(), most=5)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
