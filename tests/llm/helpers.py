"""Small documents with all the hard cases."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """rows of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def prose(rng: random.Random, n: int) -> str:
    parts = ["the", "er", "on", "and", "ing", "ti", "re", "ha", "st", "en", "ou", "wh", "ly", "nd", "sh"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def hard_rows(seed: int = 1):
    """Null, empty, blank, tiny, long, non-ASCII, equal and near-equal texts, repeated rows and null ids."""
    rng = random.Random(seed)
    base = prose(rng, 120)
    edited = base.split()
    edited[60] = "changed"
    long = prose(rng, 6000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, base), (7, base), (8, " ".join(edited)), (9, long), (10, "é漢字🙂 ünï " * 40)]
    rows += [(11, base), (11, base), (12, "a" * 3000), (13, "x y " * 400), (None, prose(rng, 50))]
    rows += [(i, prose(rng, rng.randint(5, 90))) for i in range(20, 40)]
    return rows
