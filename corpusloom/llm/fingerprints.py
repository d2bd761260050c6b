"""Document fingerprints by one-permutation MinHash (DataFrame functions only).

Every word shingle is hashed once; its top bits name a bin, and each bin keeps the smallest hash. Empty bins are filled by
optimal densification: bin j copies the first non-empty bin of an attempt sequence that depends on j alone (fixed
attempts first, then the non-empty bin with the smallest hash of the pair), so two documents that share bins borrow alike.
Of each bin the lowest 4 bits are stored, one hex digit per bin, and the likeness of two fingerprints is the share of
equal digits corrected for chance: (E - 1/16) / (1 - 1/16), cut to 0..1.

Defined results: words are runs of non-blank characters, ASCII lower-cased; a text with fewer words than a shingle is one
shingle; a text without words has the empty fingerprint, which is like another empty one (1.0) and unlike all others (0.0);
null texts count as empty; equal texts, and so repeated rows, have equal fingerprints; rows follow one another by id, ties by text, null ids first;
texts of any length are taken whole; an empty table gives an empty result; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.store import plain, stage

BIN_BITS = 7
BINS = 1 << BIN_BITS
ATTEMPTS = 12
CHANCE = 1 / 16
BLANK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, words: int) -> Column:
    """The 64-bit hashes of all word shingles (repeats included), sorted."""
    split = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BLANK), lambda x: x != "")
    single = F.transform(split, lambda x: F.xxhash64(x))

    def grown(hashes: Column) -> Column:
        def at(h: Column, i: Column) -> Column:
            return F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, words)])

        # positions past the last full shingle give hashes of partial ones; they are cut off by the slice
        return F.when(F.size(hashes) >= words, F.slice(F.transform(hashes, at), F.lit(1), F.size(hashes) - (words - 1))).when(
            F.size(hashes) > 0, F.array(F.xxhash64(hashes))
        )

    return F.sort_array(F.coalesce(_let(single, grown), F.array().cast("array<bigint>")))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda over a one-element array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bin(h: Column) -> Column:
    """Bins in the order of signed hashes."""
    return F.shiftright(h, 64 - BIN_BITS) + (BINS // 2)


def _attempts() -> list[list[int]]:
    rng = random.Random(8)
    return [[rng.randrange(BINS) for _ in range(BINS)] for _ in range(ATTEMPTS)]


def fingerprint(text: Column, words: int = 5) -> Column:
    """The fingerprint of a text: BINS hex digits, or '' without words."""
    digits = F.array(*[F.lit(f"{i:x}") for i in range(16)])
    tables = [F.array(*[F.lit(x) for x in row]) for row in _attempts()]

    def digit(h: Column) -> Column:
        return F.get(digits, h.bitwiseAND(F.lit(15)).cast("int"))

    def of_firsts(firsts: Column) -> Column:
        def sparse(bins: Column) -> Column:
            def nearest(j: Column) -> Column:
                def tried(b: Column) -> Column:
                    return F.get(firsts, F.nullif(F.array_position(bins, b), F.lit(0)).cast("int") - 1)

                ranked = F.transform(firsts, lambda h: F.struct(F.xxhash64(j, _bin(h)).alias("r"), h.alias("h")))
                return F.coalesce(tried(j), *[tried(F.get(t, j)) for t in tables], F.array_min(ranked)["h"])

            return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: digit(nearest(j))), "")

        return (
            F.when(F.size(firsts) == 0, F.lit(""))
            .when(F.size(firsts) == BINS, F.array_join(F.transform(firsts, digit), ""))
            .otherwise(_let(F.transform(firsts, lambda h: _bin(h).cast("int")), sparse))
        )

    def of_sorted(hashes: Column) -> Column:
        firsts = F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(hashes, i - 1))))
        return _let(firsts, of_firsts)

    return _let(shingle_hashes(text, words), of_sorted)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two fingerprints, 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x)) / BINS
    corrected = (same - CHANCE) / (1 - CHANCE)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), corrected))


def fingerprint_documents(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, fingerprint of every row."""
    return plain(docs, "doc_id", "text").select("doc_id", fingerprint(F.col("text"), words).alias("fingerprint"))


def _range_bucket(docs: DataFrame, rows_per_bucket: int, cells: int = 64) -> Column:
    """A bucket number that rises with doc_id: approximate quantile cells, each cut into equal widths.

    What comes to the driver is the row count and ``cells`` quantiles.
    """
    shares = [i / cells for i in range(cells + 1)]
    n, bounds = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", shares, 10_000)).first()
    if not bounds:
        return F.lit(0).cast("long")
    inner = sorted(set(bounds[1:-1]) - {bounds[0]})
    edges = [bounds[0], *inner]
    per_cell = max(1, n // (rows_per_bucket * len(edges)))

    def tree(lo: int, hi: int) -> Column:  # cell number by binary search, as nested conditions
        if lo == hi:
            start, stop = edges[lo], (edges[lo + 1] if lo + 1 < len(edges) else bounds[-1] + 1)
            width = max(1, -(-(stop - start) // per_cell))
            inside = F.floor((F.col("doc_id") - F.lit(start)) / F.lit(width)).cast("long")
            return F.lit(lo * per_cell) + F.least(F.greatest(inside, F.lit(0)), F.lit(per_cell - 1))
        mid = (lo + hi + 1) // 2
        return F.when(F.col("doc_id") < F.lit(edges[mid]), tree(lo, mid - 1)).otherwise(tree(mid, hi))

    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(tree(0, len(edges) - 1)).cast("long")


def with_next(docs: DataFrame, columns: list[str], derived: dict[str, Column] | None = None, rows_per_bucket: int = 500) -> DataFrame:
    """Add next_<column> of the following row in (doc_id, columns) order; the last row is followed by the first.

    ``derived`` columns are made of the others once per row, and have a next_<column> too. Rows are dealt by ranges of doc_id and looked at within a
    range; the first row of each range is passed on by a join over ranges, so no task sees more than its range. Of all rows only the first of
    each range, found without the derived columns, are derived a second time.
    """
    derived = derived or {}
    dealt = docs.withColumn("bucket", _range_bucket(docs, rows_per_bucket))
    order = Window.partitionBy("bucket").orderBy("doc_id", *columns)
    seen = dealt.withColumns(derived)
    seen = seen.withColumns({f"next_{c}": F.lead(c).over(order) for c in [*columns, *derived]} | {"last": F.lead(F.lit(True)).over(order).isNull()})

    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", *columns))  # null ids have a range of their own
    heads = stage(dealt.groupBy("bucket").agg(first.alias("head")), "fp-heads")
    ring = Window.partitionBy(F.lit(1)).orderBy("bucket")
    whole = Window.partitionBy(F.lit(1))
    follow = heads.select("bucket", F.coalesce(F.lead("bucket").over(ring), F.min("bucket").over(whole)).alias("next_bucket"))
    rows = heads.select(F.col("bucket").alias("next_bucket"), *[F.col(f"head.{c}").alias(c) for c in columns]).withColumns(derived)
    passed = stage(follow.join(rows.select("next_bucket", F.struct(*columns, *derived).alias("head")), "next_bucket").select("bucket", "head"), "fp-passed")
    out = seen.join(passed, "bucket", "left")
    return out.withColumns({f"next_{c}": F.when(F.col("last"), F.col(f"head.{c}")).otherwise(F.col(f"next_{c}")) for c in [*columns, *derived]}).drop("bucket", "last", "head")


def compare_edited(docs: DataFrame, words: int = 5) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness.

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many of the next document.
    """
    base = plain(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = with_next(base, ["text"], {"fingerprint": fingerprint(F.col("text"), words)}).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)
    )
    pairs = pairs.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited"), words))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
