import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm.fingerprints import _attempts, compare_edited, fingerprint, likeness
from corpusloom.llm.licenses import KNOWN, canonical, scan_licenses
from corpusloom.llm.mixing import mix_sources, mixed_documents
from tests.llm.helpers import SCHEMA, frame, hard_rows, prose


def targets(sizes, cap=3):
    """Reshare until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    fixed = {}
    while True:
        left = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in order if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def mix_rows():
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), None if i % 11 == 0 else f"s{i % 5}") for i in range(400)]
    return rows + [(1000 + i, "a b", "tiny") for i in range(3)] + [(2000, None, "none"), (2001, "", "s1"), (7, rows[7][1], rows[7][2])]


def test_mix_meets_its_targets(spark):
    got = mix_sources(frame(spark, mix_rows())).collect()
    assert len(got) == len(mix_rows())
    sizes, taken, said = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        said[r.source] = (r.source_size, r.target)
        assert r.taken <= 3 * r.size
    want = targets(sizes)
    for s in sizes:
        assert said[s][0] == sizes[s] and said[s][1] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 40


def test_mix_reruns_agree_and_returns_documents(spark):
    docs = frame(spark, mix_rows())
    a, b = mix_sources(docs).collect(), mix_sources(docs.repartition(7)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, a)) == sorted(map(key, b))
    clash = docs.withColumn("size", F.lit(1)).withColumn("bucket", F.lit("x"))
    out = mixed_documents(clash)
    assert out.columns == clash.columns and out.count() == sum(r.copies for r in a)


def test_mix_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mix_sources(frame(spark, [(1, None), (2, " ")])).collect()] == [0, 0]


def shingles(text, n=5):
    w = [x for x in text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def test_fingerprints_follow_similarity(spark):
    rows = sorted((r for r in hard_rows() if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    got = sorted(compare_edited(frame(spark, rows)).collect(), key=lambda r: r.doc_id)
    assert len(got) == len(rows)
    prints = {}
    for i, ((_, text), r) in enumerate(zip(rows, got, strict=True)):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        for said, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert 0 <= said <= 1 and abs(said - true) < 0.25


def test_fingerprint_of_few_shingles_and_empties(spark):
    df = spark.createDataFrame([("",), ("one",), ("One",), ("a b c d e f",), (None,)], "text string")
    p = [r[0] for r in df.select(fingerprint(F.col("text"))).collect()]
    assert p[0] == p[4] == "" and p[1] == p[2] and len(p[1]) == 128 and p[1] != p[3]
    near = spark.createDataFrame([(p[1], p[3]), ("", ""), ("", p[1])], "a string, b string").select(likeness(F.col("a"), F.col("b"))).collect()
    assert near[0][0] < 0.3 and near[1][0] == 1.0 and near[2][0] == 0.0


def test_fingerprints_of_an_empty_table(spark):
    assert compare_edited(spark.createDataFrame([], SCHEMA)).count() == 0


def test_licences(spark):
    mit = next(body for name, kind, body in KNOWN if name == "MIT" and kind == "text")
    rows = [(1, mit.upper().replace("License", "Licence").replace(" ", "  ")), (2, "Copyright (c) 2020 X\n" + mit), (3, "prose\nreleased under the MIT licence\nmore"), (4, None), (5, ""), (6, mit + " and more"), (3, "x")]
    got = sorted(scan_licenses(frame(spark, rows)).collect(), key=lambda r: (r.doc_id, r.n_header_lines))
    assert [r.text_license for r in got] == ["MIT", "MIT", None, None, None, None, None]
    assert [r.header_licenses for r in got if r.doc_id == 3] == ["", "MIT"]
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def print_by_definition(text, n=5):
    """The fingerprint of a text, bin by bin."""
    signed = lambda u: u - (1 << 64) if u >> 63 else u

    def chain(values):  # hashes of longs, each seeded with the one before
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest((v & (2**64 - 1)).to_bytes(8, "little"), h)
        return signed(h)

    words = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    single = [signed(xxhash.xxh64_intdigest(w, 42)) for w in words]
    if not single:
        return ""
    hashes = [chain(single[i : i + n]) for i in range(len(single) - n + 1)] or [chain(single)]
    first = {}
    for h in sorted(hashes):
        first.setdefault((h >> 57) + 64, h)
    digits = []
    for j in range(128):
        tried = [j, *(t[j] for t in _attempts())]
        h = next((first[b] for b in tried if b in first), None)
        if h is None:  # the non-empty bin with the smallest hash of the pair
            h = min((signed(xxhash.xxh64_intdigest(((b + (1 << 64)) % (1 << 64)).to_bytes(8, "little"), xxhash.xxh64_intdigest(j.to_bytes(4, "little"), 42))), first[b]) for b in first)[1]
        digits.append(f"{h & 15:x}")
    return "".join(digits)


def test_fingerprints_match_their_definition(spark):
    rng = random.Random(6)
    texts = [prose(rng, n) for n in (1, 3, 5, 6, 9, 40, 300, 3000)] + ["", " \n", "É é Ünï 漢字 🙂 x"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", fingerprint(F.col("text")).alias("p")).collect()
    for r in got:
        want = print_by_definition(texts[r.i])
        assert r.p == want, (r.i, len(texts[r.i].split()))


def test_rows_follow_one_another_by_id_then_text(spark):
    rows = [(2, "b b b b"), (2, "a a a a"), (1, "z z z z"), (None, "n n n n"), (9, "y y y y"), (2, "a a a a")]
    docs = frame(spark, rows).selectExpr("*", "1 as bucket", "2 as last", "3 as head", "4 as `a.b`", "5 as next_text")
    order = [(None, "n n n n"), (1, "z z z z"), (2, "a a a a"), (2, "a a a a"), (2, "b b b b"), (9, "y y y y")]
    want = []
    for i, (d, t) in enumerate(order):
        edited = t[: len(t) - len(t) // 4] + order[(i + 1) % len(order)][1][: len(t) // 4]
        want.append((d, hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.edited_sha256) for r in compare_edited(docs).collect()), key=key) == sorted(want, key=key)


def test_licences_of_own_tables_and_whole_catalogue(spark):
    rows = [(i, body) for i, (_, _, body) in enumerate(KNOWN)] * 2
    docs = frame(spark, rows).selectExpr("*", "1 as digest", "2 as `row`", "3 as license", "4 as `a.b`")
    assert {(r.doc_id, r.text_license) for r in scan_licenses(docs).collect()} == {(i, name) for i, (name, _, _) in enumerate(KNOWN)}
    own = spark.createDataFrame([("House-1", "Use it as you like."), ("Also-1", "USE it as you like")], "license string, body string")
    known = own.select("license", F.md5(canonical(F.col("body"))).alias("digest"))
    got = scan_licenses(frame(spark, [(1, "one\nuse it, as you like!\nUse it as you like.")]), known).first()
    assert (got.header_licenses, got.n_header_lines) == ("Also-1", 2)


def test_licence_lines_in_any_known_spelling(spark):
    rows = [(1, "Li(c)ensed under CC BY 4.0."), (2, "x\r\nLihttp://censed under CC0 1.0.\r\n\ny"), (3, "# released   under the MIT-licence!\rLICENSED UNDER CC0 1.0"), (4, "Copyright CC0 1.0\nl\ni")]
    rows += [(5, "\n".join(["Licensed under CC0 1.0."] * 3)), (6, "word " * 200_000 + "\nLicensed under CC BY-SA 4.0.")]
    got = {r.doc_id: (r.header_licenses, r.n_header_lines) for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {1: ("CC-BY-4.0", 1), 2: ("CC0-1.0", 1), 3: ("CC0-1.0,MIT", 2), 4: ("", 0), 5: ("CC0-1.0", 3), 6: ("CC-BY-SA-4.0", 1)}


def test_mix_with_names_that_clash(spark):
    docs = frame(spark, mix_rows())
    odd = docs.selectExpr("*", "1 as size", "2 as src", "3 as turn", "4 as `a.b`", "5 as copies", "6 as whole_row")
    out = mixed_documents(odd)
    assert out.columns == odd.columns and sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixed_documents(docs).collect())
