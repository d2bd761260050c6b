"""The trie of conversation prefixes and its totals per subtree.

1. Turns are put in order by a range partition and a sort, so that one conversation may spread over many tasks. A running digest of
   every prefix is a polynomial over the turns' digests: each task sums its own part, and what comes before it in
   the same conversation is added from the totals of the tasks (a prefix sum in two levels).
2. Because the digest is a polynomial, a conversation whose first turns are replaced gets its digests from those of both parts.
3. Prefixes that are equal have equal digests (128 bits) and are one node; a node knows its parent's digest.
4. Totals of subtrees by pointer jumping: after k rounds a node holds the totals of its descendants nearer than 2**k, and a
   pointer 2**k levels up. A round adds every node's total to the node that it points to and doubles the pointers, so a chain
   of n turns takes log2(n) rounds, not n.

Only partial sums per pointer are shuffled; pointers to the root are known from the depth and never joined, and what is left of
hot pointers is a join whose large partitions Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import drop_stage, frugal, plain, small_batches, stage

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
LIST_IDS = 1 << 14  # ids that are joined before the digest of a node's list is taken
_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def _powers(first: int, n: int) -> np.ndarray:
    """The powers first, first + 1, ... of the base, modulo 2**64."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = pow(BASE, first, 1 << 64)
    return np.cumprod(out, out=out) if n else out


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and running digests of sorted turns within this task; of each turn's digest and of that before it."""
    part = TaskContext.get().partitionId()
    conv, seen, sums = None, 0, [0, 0]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch["conv_id"].to_numpy()
        terms = np.frombuffer(b"".join(batch["digest"].to_pylist()), np.uint64).reshape(n, 2)
        opens = np.concatenate([[ids[0] != conv], ids[1:] != ids[:-1]])
        begin = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
        place = np.arange(n) - begin + 1
        lead = int(np.argmax(opens)) if opens.any() else n  # these belong to the conversation of the batch before
        place[:lead] += seen
        power = _powers(1, int(place.max()))[place - 1]
        out = []
        for k in range(2):
            upto = np.cumsum(terms[:, k] * power)
            before = np.concatenate([np.zeros(1, np.uint64), upto[:-1]])
            base = before[begin]
            base[:lead] = np.uint64(0) - np.uint64(sums[k])
            out += [upto - base, before - base]
            sums[k] = int(out[-2][-1])
        conv, seen = ids[-1], int(place[-1])
        arrays = [pa.array(np.full(n, part)), batch["conv_id"], pa.array(place), *(pa.array(out[i].view(np.int64)) for i in (0, 2, 1, 3)), batch["n"]]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "conv_id", "pos", "k1", "k2", "p1", "p2", "n"])


def _shifted(offsets: dict[int, tuple[int, int, int, int]]):
    """Adds to the first conversation of a part what earlier parts hold of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch["conv_id"].to_numpy(), batch["part"].to_numpy()
            place = batch["pos"].to_numpy().copy()
            keys = {c: batch[c].to_numpy().view(np.uint64).copy() for c in ("k1", "k2", "p1", "p2")}
            for part in np.unique(parts).tolist():
                if part in offsets:
                    conv, n, *sums = offsets[part]
                    own = (parts == part) & (ids == conv)
                    place[own] += n
                    for c in keys:
                        keys[c][own] = np.uint64(sums[c[1] == "2"]) + keys[c][own] * np.uint64(pow(BASE, n, 1 << 64))
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(place), *(pa.array(x.view(np.int64)) for x in keys.values()), batch["n"]], names=PREFIX)

    return frugal(run)


PREFIX = ["conv_id", "pos", "k1", "k2", "p1", "p2", "n"]
PREFIX_TYPES = "conv_id long, pos long, k1 long, k2 long, p1 long, p2 long, n long"


def turn_digest(role: Column, text: Column) -> Column:
    """What a turn says, as 32 hex digits; it also orders turns of one number."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, pos (from 1), the digest (k1, k2) of the turns up to this one and (p1, p2) of those before it, n (code points).

    Turns are in order of turn (null first), then of turn_digest(). Null role or text counts as empty, rows without conv_id are left out, repeated rows are turns of their own.
    """
    small_batches(turns.sparkSession)
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    own = plain(turns, "conv_id", "turn", "role", "text").where("conv_id is not null")
    rows = own.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("said"), F.length(text).cast("long").alias("n"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "pt-turns")
    order = ["conv_id", "turn", "said", "row"]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.unhex("said").alias("digest"), "n")
    first = stage(sorted_rows.mapInArrow(frugal(_running), f"part long, {PREFIX_TYPES}"), "pt-parts")
    drop_stage(rows)
    # a row per task: its first conversation, and where its last one stands
    last = F.max_by(F.struct("conv_id", "pos", "k1", "k2"), F.struct("conv_id", "pos")).alias("last")
    ends = first.groupBy("part").agg(F.min("conv_id").alias("first"), last).orderBy("part").collect()
    offsets, carry = {}, (None, 0, 0, 0)
    for r in ends:
        if r["first"] == carry[0]:
            offsets[r["part"]] = carry
        mine = (r["last"]["conv_id"], r["last"]["pos"], r["last"]["k1"] & _MASK, r["last"]["k2"] & _MASK)
        if mine[0] == carry[0]:
            up = pow(BASE, carry[1], 1 << 64)
            mine = (mine[0], carry[1] + mine[1], (carry[2] + up * mine[2]) & _MASK, (carry[3] + up * mine[3]) & _MASK)
        carry = mine
    if not offsets:
        return first.select(*PREFIX)
    out = stage(first.mapInArrow(_shifted(offsets), PREFIX_TYPES), "pt-prefixes")
    drop_stage(first)
    return out


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of prefixes whose first ``h`` turns (digest a) are replaced by ``m`` others (digest b)."""
    for batch in batches:
        step = batch["m"].to_numpy() - batch["h"].to_numpy()
        low, high = (int(step.min()), int(step.max())) if len(step) else (0, 0)
        power = _powers(low, high - low + 1)[step - low]
        u = {c: batch[c].to_numpy().view(np.uint64) for c in ("k1", "k2", "p1", "p2", "a1", "a2", "b1", "b2")}
        keys = [pa.array((u[f"b{k}"] + power * (u[f"{c}{k}"] - u[f"a{k}"])).view(np.int64)) for c in "kp" for k in (1, 2)]
        depth = pa.array(batch["pos"].to_numpy() + step)
        yield pa.RecordBatch.from_arrays([batch["conv_id"], depth, *keys, batch["n"]], names=PREFIX)


def share_heads(turns: DataFrame, head: Column, source: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: the prefixes, as prefixes() gives them, and (conv_id, depth) of every conversation.

    ``head`` (0 to ``most``) and ``source`` are columns of conv_id: the first ``head`` turns of conversation ``source`` (all if it has fewer, none if there is no such) take the
    place of as many of the conversation's own. A source may serve any number of conversations.
    """
    zero = F.lit(0).cast("long")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own")).withColumn("h", head.cast("long")).withColumn("source", source.cast("long"))
    starts = turns.where(F.col("pos") <= most)
    own = starts.where(F.col("pos") == head).select("conv_id", F.col("k1").alias("a1"), F.col("k2").alias("a2"))
    lent = convs.where("h > 0").select(F.col("source").alias("conv_id")).distinct()
    lent = stage(starts.join(lent, "conv_id", "left_semi"), "pt-heads")
    sizes = lent.groupBy("conv_id").agg(F.max("pos").alias("n_lent")).withColumnRenamed("conv_id", "source")
    convs = convs.join(own, "conv_id", "left").join(sizes, "source", "left").withColumn("m", F.least("h", F.coalesce("n_lent", zero)))
    at = lent.select(F.col("conv_id").alias("source"), F.col("pos").alias("m"), F.col("k1").alias("b1"), F.col("k2").alias("b2"))
    convs = convs.join(at, ["source", "m"], "left").fillna(0, ["a1", "a2", "b1", "b2"])
    convs = stage(convs.withColumn("depth", F.col("m") + F.greatest(F.col("n_own") - F.col("h"), zero)), "pt-convs")
    joined = turns.where(F.col("pos") > head).join(convs.select("conv_id", "h", "m", "a1", "a2", "b1", "b2"), "conv_id")
    rest = joined.mapInArrow(frugal(_replaced), PREFIX_TYPES)
    heads = convs.where("m > 0").select(F.col("conv_id").alias("taker"), "source", "m").join(lent.withColumnRenamed("conv_id", "source"), "source").where("pos <= m")
    heads = heads.select(F.col("taker").alias("conv_id"), *PREFIX[1:])
    return stage(rest.unionByName(heads), "pt-members"), convs.select("conv_id", "depth")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of a node as text, of bounded length."""

    def text(ids: list[int]) -> str:
        return ",".join(map(str, ids))

    key, ids = None, []
    for batch in batches:
        done = []
        for k1, k2, conv in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "conv_id")), strict=True):
            if (k1, k2) != key or len(ids) >= LIST_IDS:
                if ids:
                    done.append((*key, ids[0], text(ids)))
                key, ids = (k1, k2), []
            ids.append(conv)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["k1", "k2", "low", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, ids[0], text(ids))], names=["k1", "k2", "low", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined runs, fed one after the other."""
    key, state = None, None
    for batch in batches:
        done = []
        for k1, k2, ids in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, state.hexdigest())], names=["k1", "k2", "ends_sha256"])


def list_digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined conv_ids of every node (k1, k2).

    A node with very many ids is sorted and joined in many tasks; only the digest itself, which has an order, is taken in one, run by run.
    """
    order = ["k1", "k2", "conv_id"]
    runs = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(frugal(_joined), "k1 long, k2 long, low long, ids string")
    return runs.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "low").mapInArrow(frugal(_digested), "k1 long, k2 long, ends_sha256 string")


def roll_up(nodes: DataFrame, totals: list[str], deepest: int) -> DataFrame:
    """``nodes`` (k1, k2, depth, p1, p2 and ``totals``) with the totals summed over each node's subtree; the root is (0, 0) at depth 0.

    The columns p1 and p2 of the result are pointers of the last round, and no longer the parent's.
    """
    now, reach = nodes, 1
    while reach <= deepest:
        added = now.where(F.col("depth") >= reach).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*[F.sum(t).alias(f"_{t}") for t in totals])
        plus = now.join(added, ["k1", "k2"], "left")
        plus = plus.select("k1", "k2", "depth", "p1", "p2", *[(F.col(t) + F.coalesce(f"_{t}", F.lit(0))).alias(t) for t in totals])
        # pointers twice as long: to the root from this depth, none above it, and else those of the nodes pointed to
        near = plus.where(F.col("depth") <= 2 * reach).withColumns({c: F.when(F.col("depth") == 2 * reach, F.lit(0).cast("long")) for c in ("p1", "p2")})
        ahead = now.where(F.col("depth") > reach).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("j1"), F.col("p2").alias("j2"))
        far = plus.where(F.col("depth") > 2 * reach).join(ahead, ["p1", "p2"]).select("k1", "k2", "depth", F.col("j1").alias("p1"), F.col("j2").alias("p2"), *totals)
        after = stage(near.unionByName(far), "pt-round")
        if now is not nodes:
            drop_stage(now)
        now, reach = after, 2 * reach
    return now


def prefix_trie(members: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, k1, k2.

    members: rows of prefixes(); convs: conv_id and depth (number of turns), conversations without turns too. saved_tokens: code points that a cache of prefixes saves, that
    is each node's code points times its members but one, summed over the subtree. Without conversations there is no root and no row.
    """
    found = members.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("n").alias("n")
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "conv_id", zero.alias("depth"), "n_convs", none.alias("p1"), none.alias("p2"), zero.alias("n"))
    nodes = stage(found.unionByName(root), "pt-found")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").fillna(0, ["n_children"])
    nodes = stage(nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n")), "pt-nodes")
    top = nodes.agg(F.max("depth").alias("deepest"), F.min(F.when(F.col("depth") == 0, F.col("conv_id"))).alias("conv_id")).first()
    sums = roll_up(nodes.select("k1", "k2", "depth", "p1", "p2", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], top["deepest"] or 0)
    sizes = convs.withColumnRenamed("depth", "size")
    ending = members.join(sizes, "conv_id").where("pos = size").select("k1", "k2", "conv_id")
    ending = ending.unionByName(convs.where("depth = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    facts = nodes.drop("n_leaves", "saved_tokens").join(sums.select("k1", "k2", "n_leaves", "saved_tokens"), ["k1", "k2"])
    facts = stage(facts.join(list_digests(ending), ["k1", "k2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))), "pt-facts")
    parents = nodes.where("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    low = facts.where("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top["conv_id"]).cast("long")))
    out = facts.where("depth > 1").join(parents, ["p1", "p2"]).unionByName(low)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "k1", "k2")


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the conversations in ``turns`` (conv_id, turn, role, text) as they are.

    Defined results: order, nulls and repeated rows as in prefixes(); equal prefixes of any conversations are one node, whatever their turn numbers; texts and conversations of
    any length count whole; an empty table gives no rows; extra columns, whatever their names, are ignored.
    """
    members = prefixes(turns)
    convs = stage(members.groupBy("conv_id").agg(F.max("pos").alias("depth")), "pt-convs")
    return prefix_trie(members, convs)
