"""Near-duplicate classes by SetSketch registers.

A document's set is that of its distinct word shingles. Register i of its sketch is the truncated, exponentially spaced
minimum ``clip(floor(1 - log_b(min_x h_i(x))), 0, q + 1)`` of exponential hashes with rate a: sketches of
parts merge by taking maxima, and two registers agree with a probability that follows the Jaccard similarity.

1. Equal sets (by 128 bits of digest) are one class. One row per class goes on.
2. Bands of registers are hashed; classes that share a band are candidates.
3. In every bucket the candidates first meet one hub, the member that shares most bands with others. A joint maximum-likelihood
   estimate from the counts of larger, equal and smaller registers drops such a pair only where the threshold is less than
   e**-16 times as likely as the best similarity; the others are confirmed on full sets: 100 * intersection >= percent * union.
4. Where a bucket still spans several components, its members outside the hub's component meet all others (the hub excepted)
   in blocks of a bounded number. A block counts all intersections with one matrix product and returns links between
   different components only, as a forest: pairs are never listed, and no partner is capped.
5. Components come from the confirmed links.

A link of similarity s shares no band with probability (1 - s**4)**16 at most: 7e-6 at 0.85, 2e-4 at 0.8; bands can be
raised. Defined results: see near_duplicates().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.store import frugal, numbered, plain, stage
from corpusloom.llm.words import mix, shingle_sets, stream

BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2  # b, a and q of the sketch
STEP = 16_384  # hashes whose registers are computed at once
CELLS = 4_000_000  # of an incidence matrix at once
SLACK = 16.0  # nats below the best likelihood
SKETCH = "doc_id long, mark long, n long, node long, check long, regs binary, bands array<long>"


def registers(sets: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """SetSketch registers of one set of hashes."""
    low = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(sets), STEP):  # parts merge by their minima; a very long text takes no more memory than a long one
        np.minimum(low, ((sets[at : at + STEP, None] ^ salts[None, :]) * np.uint64(0xD6E8FEB86659FD93)).min(axis=0), out=low)
    uniform = (low >> np.uint64(11)).astype(np.float64) / 2.0**53
    exponential = np.maximum(-np.log1p(-uniform), 1e-300) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def similarity_likelihood(k_a: np.ndarray, k_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Log likelihood of every similarity of ``grid`` for pairs of sketches (one pair a row)."""
    more, less = (k_a > k_b).sum(axis=1)[:, None], (k_a < k_b).sum(axis=1)[:, None]
    same = k_a.shape[1] - more - less
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(grid[None, :], np.minimum(u / v, v / u))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + same * np.log(np.maximum(1 - up - down, tiny))


def _sketcher(words: int, bands: int, rows: int, node_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = stream(23, bands * rows)
        mult = (stream(29, rows) | np.uint64(1))[None, :]
        turn = stream(31, bands)
        for batch in batches:
            n, node, check, regs, keys = [], [], [], [], []
            for s in shingle_sets(batch["text"], words):
                n.append(len(s))
                if not len(s):
                    node.append(None), check.append(None), regs.append(None), keys.append([])
                    continue
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                node.append(int.from_bytes(digest[:node_bytes], "little", signed=True)), check.append(int.from_bytes(digest[8:], "little", signed=True))
                k = registers(s, salts)
                regs.append(k.tobytes())
                keys.append(mix((k.reshape(bands, rows).astype(np.uint64) * mult).sum(axis=1, dtype=np.uint64) + turn).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["mark"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n", "node", "check", "regs", "bands"],
            )

    return run


def _plausible(percent: int):
    grid = np.linspace(0.0, 1.0, 101)
    far = grid * 100 >= percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k_a, k_b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("regs_a", "regs_b"))
            n_a, n_b = (batch[c].to_numpy().astype(float) for c in ("n_a", "n_b"))
            ll = similarity_likelihood(k_a, k_b, n_a, n_b, grid)
            # sets whose sizes alone rule the threshold out cannot be links at all
            keep = (ll[:, far].max(axis=1) >= ll.max(axis=1) - SLACK) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["a", "b"])

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in batches:
            nodes, keep = batch["a"].to_numpy(), np.zeros(batch.num_rows, bool)
            change = np.nonzero(np.diff(nodes, prepend=nodes[:1] - 1))[0] if len(nodes) else []
            hubs = dict(zip(nodes[change].tolist(), shingle_sets(batch["text_a"].take(pa.array(change, pa.int64())), words), strict=True)) if len(nodes) else {}
            for i, other in enumerate(shingle_sets(batch["text_b"], words)):
                if nodes[i] != held:
                    held, own = nodes[i], hubs[int(nodes[i])]
                joint = len(own) + len(other) - len(np.union1d(own, other))
                keep[i] = 100 * joint >= percent * (len(own) + len(other) - joint)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["u", "v"])

    return run


def _open_blocks(members: DataFrame, hubs: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """task, node, component, far: which members of buckets that span components are still to meet, dealt into blocks."""
    placed = members.select("band", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    core = hubs.join(parts.toDF("hub", "core"), "hub", "left").select("band", "hub", F.coalesce("core", "hub").alias("core"))
    rest = placed.join(core, "band").where("node <> hub").withColumn("far", F.col("component") != F.col("core"))
    # the hub has met all members; a pair is left only between two others of different components
    crowd = (
        rest.groupBy("band")
        .agg(F.sum(F.col("far").cast("long")).alias("n_far"), F.sum((~F.col("far")).cast("long")).alias("n_core"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("n_far > 0 and lo <> hi")
    )
    crowd = crowd.select("band", F.ceil(F.col("n_far") / block).cast("int").alias("b_far"), F.ceil(F.col("n_core") / block).cast("int").alias("b_core"))
    dealt = rest.join(crowd, "band").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("far"), F.col("b_far")).otherwise(F.col("b_core"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("b_far") - 1)
    # far blocks meet each other (smaller number first) and every core block, which counts from b_far on
    with_far = F.transform(others, lambda j: F.struct(F.least(F.col("own"), j).alias("i"), F.greatest(F.col("own"), j).alias("j")))
    with_core = F.when(F.col("b_core") > 0, F.transform(F.sequence(F.lit(0), F.col("b_core") - 1), lambda j: F.struct(F.col("own").alias("i"), (j + F.col("b_far")).alias("j"))))
    of_far = F.concat(with_far, F.coalesce(with_core, F.array().cast("array<struct<i:int,j:int>>")))
    of_core = F.transform(others, lambda i: F.struct(i.alias("i"), (F.col("own") + F.col("b_far")).alias("j")))
    met = dealt.withColumn("meet", F.explode(F.when(F.col("far"), of_far).otherwise(of_core)))
    return met.select(F.xxhash64("band", "meet.i", "meet.j").alias("task"), "node", "component", "far")


def _forest(sets: list[np.ndarray], nodes: list[int], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that join different labels, at most one for each label joined."""
    sizes = np.array([len(s) for s in sets])
    flat, cell = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    joint = np.zeros((len(sets), len(sets)), np.int64)
    width = max(1, CELLS // len(sets))
    for lo in range(0, len(flat), width):  # memory stays bounded for long texts; counts of a part are exact in float32
        part = (cell >= lo) & (cell < lo + width)
        incidence = np.zeros((len(sets), min(width, len(flat) - lo)), np.float32)
        incidence[owner[part], cell[part] - lo] = 1
        joint += (incidence @ incidence.T).astype(np.int64)
    linked = 100 * joint >= percent * (sizes[:, None] + sizes[None, :] - joint)
    _, own = np.unique(np.array(labels), return_inverse=True)
    rows, cols = np.nonzero(np.triu(linked & (own[:, None] != own[None, :])))
    root = list(range(int(own.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for r, c in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = find(int(own[r])), find(int(own[c]))
        if a != b:
            root[a] = b
            out.append((nodes[r], nodes[c]))
    return out


def _block_links(words: int, percent: int):
    def flush(rows: dict[int, tuple[int, str]]) -> list[tuple[int, int]]:
        if len({label for label, _ in rows.values()}) < 2:
            return []
        return _forest(list(shingle_sets(pa.array([t for _, t in rows.values()], pa.string()), words)), list(rows), [label for label, _ in rows.values()], percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows, out = None, {}, []
        for batch in batches:
            for t, node, label, text in zip(*(batch[c].to_pylist() for c in ("task", "node", "component", "text")), strict=True):
                if t != task:
                    out += flush(rows)
                    task, rows = t, {}
                rows[node] = (label, text)
            yield _pairs(out)
            out = []
        yield _pairs(flush(rows))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 16, rows: int = 4, block: int = 256, node_bytes: int = 8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    component_id is the smallest doc_id of the documents reachable by links, itself included; kept says whether that is the
    document itself.
    Defined results: texts that are null or have no words have an empty set and stand alone; rows with equal doc_id are one node if
    their sets are equal; equal sets are always linked; a similarity of exactly ``percent`` links; of equal ids in a class each row is kept;
    null doc_ids take part and stand for themselves if nothing with an id is linked; rows of one doc_id with different texts are judged each by its own
    text; texts of any length are taken whole; extra columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    return _near_classes(docs, words, percent, bands, rows, block, node_bytes).drop("mark")


def _near_classes(docs: DataFrame, words: int, percent: int, bands: int = 16, rows: int = 4, block: int = 256, node_bytes: int = 8) -> DataFrame:
    """near_duplicates() with mark, the hash of the row's text."""
    docs = plain(docs, "doc_id", "text").withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketches = stage(docs.mapInArrow(frugal(_sketcher(words, bands, rows, node_bytes)), SKETCH), "ss-sketch")
    classes = stage(
        sketches.where("n > 0")
        .groupBy("node", "check")
        .agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("pick"), F.first("n").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")),
        "ss-class",
    )
    sketches, classes = _told_apart(sketches, classes)
    shared = classes.select("node", F.explode("bands").alias("band"))
    crowded = shared.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stage(shared.join(crowded, "band"), "ss-members")
    weights = members.groupBy("node").agg(F.sum("members").alias("weight"))
    members = stage(members.select("band", "node").join(weights, "node"), "ss-members")

    # the text is taken from a row of the class itself: a doc_id may repeat with other texts, or be null
    picks = classes.select("node", F.col("pick.doc_id").alias("pick_id"), F.col("pick.mark").alias("pick_mark"))
    picks = members.select("node").distinct().join(picks, "node")
    own = docs["doc_id"].eqNullSafe(F.col("pick_id")) & (docs["mark"] == F.col("pick_mark"))
    first_rows = stage(docs.join(picks, own).select("node", "text"), "ss-text")
    again = first_rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    texts = first_rows.dropDuplicates(["node"]) if again.limit(1).count() else first_rows
    sizes = classes.select("node", "n", "regs")

    hubs = stage(members.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("hub")).select("band", F.col("hub.node").alias("hub")), "ss-hubs")
    pairs = members.join(hubs, "band").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sided = pairs.join(sizes.toDF("a", "n_a", "regs_a"), "a").join(sizes.toDF("b", "n_b", "regs_b"), "b")
    likely = stage(sided.mapInArrow(frugal(_plausible(percent)), "a long, b long"), "ss-likely")
    text = texts.select("node", "text")
    full = likely.join(text.toDF("b", "text_b"), "b").join(text.toDF("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    links = stage(full.mapInArrow(frugal(_confirm(words, percent)), "u long, v long"), "ss-links")
    parts = stage(connected_components(links).toDF("node", "component"), "ss-parts")

    blocks = _open_blocks(members, hubs, parts, block)
    shipped = blocks.join(text, "node").repartition("task").sortWithinPartitions("task")
    more = stage(shipped.select("task", "node", "component", "far", "text").mapInArrow(frugal(_block_links(words, percent)), "u long, v long"), "ss-links")
    if more.limit(1).count():
        parts = stage(connected_components(links.unionByName(more)).toDF("node", "component"), "ss-parts")

    named = classes.select("node", "rep").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select("node", "component_id")
    component = F.coalesce("component_id", "doc_id")
    return sketches.select("doc_id", "mark", "n", "node").join(named, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        "mark",
    )


def _told_apart(sketches: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes are equal in 128 bits of digest; where their first 64, the node, are those of another class as well, all but one get another node."""
    twins = classes.groupBy("node").agg(F.min("check").alias("first"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("node", "first")
    if not twins.limit(1).count():
        return sketches, classes

    def apart(df: DataFrame) -> DataFrame:
        other = F.col("first").isNotNull() & (F.col("check") != F.col("first"))
        return df.join(twins, "node", "left").withColumn("node", F.when(other, F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("first")

    return stage(apart(sketches), "ss-sketch"), stage(apart(classes), "ss-class")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each near-duplicate class, that with the smallest doc_id; all columns stay, whatever their names.

    Rows with null doc_id stay; of rows with equal doc_id and equal texts one stays; an empty table stays empty.
    """
    named = _near_classes(docs, words, percent)
    kept = named.where("kept").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("kept_rows"))
    kept = stage(kept.toDF("kept_id", "kept_mark", "kept_rows"), "ss-kept")
    place = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    doc_id, text = place["doc_id"], place["text"]
    own = F.col(doc_id).eqNullSafe(F.col("kept_id")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("kept_mark"))
    out = numbered(docs).join(kept, own)
    if kept.where("kept_rows > 1 and kept_id is not null").limit(1).count():
        again = (F.col("kept_rows") > 1) & F.col(doc_id).isNotNull()
        out = out.where(~again).unionByName(out.where(again).dropDuplicates([doc_id, text]))
    return out.select(*place.values()).toDF(*docs.columns)
