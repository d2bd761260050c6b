"""Groups of spelling variants among all words of a corpus.

Words one insertion, deletion or replacement apart agree in the first or in the second half of the longer one. Words meet by that half:
once as they are, for a forward automaton, and once reversed, for a backward one (corpusloom.llm.word_automata). A task builds an
automaton over the words of many halves, follows every word exactly through its half and completes it with one error; word numbers
of the automaton lead back to the words. A pair found both ways counts once.

A half that very many words share is no burden for one task: its words meet by half and by a part of the rest, so that the place of the error
is halved, as often as is needed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import drop_stage, frugal, plain, small_batches, stage
from corpusloom.llm.word_automata import Automaton
from corpusloom.llm.words import blocks, buffers

CHUNK = 1 << 16  # rows of words in one automaton
HOT = 1 << 16  # rows that share a half, beyond which it is refined
KNOWN_WORDS = 1 << 18  # distinct words whose counts a task holds
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True  # 0xC3 begins U+00C0 to U+00FF
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)  # the table of the reflected polynomial
for _ in range(8):
    _CRC = (_CRC >> np.uint32(1)) ^ np.where(_CRC & 1, np.uint32(0xEDB88320), np.uint32(0))


def letter_runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of letters A-Z, a-z and U+00C0 to U+00FF."""
    solid = _LETTER[data]
    solid[1:] |= data[:-1] == 0xC3
    edge = np.concatenate([[False], solid, [False]])
    first, last = edge[1:-1] & ~edge[:-2], edge[1:-1] & ~edge[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    return np.nonzero(first)[0], np.nonzero(last)[0] + 1


def _crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, continued from ``state``."""
    crc, n = ~state, ends - starts
    turn = np.argsort(-n, kind="stable")
    crc, at, n = crc[turn], starts[turn], n[turn]
    live = len(n)
    for j in range(int(n.max(initial=0))):
        live = int(np.searchsorted(-n[:live], -j, "left"))
        part = crc[:live]
        crc[:live] = _CRC[(part ^ data[at[:live] + j]) & 255] ^ (part >> np.uint32(8))
    out = np.empty_like(crc)
    out[turn] = ~crc
    return out


def _counted(least: int, drop_one_in: int):
    def some(batch: pa.RecordBatch, offsets: np.ndarray, data: np.ndarray, a: int, b: int) -> pa.Array:
        own, text = offsets[a : b + 1] - offsets[a], _LOWER[data[offsets[a] : offsets[b]]]
        starts, ends = letter_runs(own, text)
        wide = np.concatenate([[0], np.cumsum(text == 0xC3)])
        size = ends - starts - (wide[ends] - wide[starts])
        long = size >= least
        starts, ends, size = starts[long], ends[long], size[long]
        at = np.concatenate([[0], np.cumsum(ends - starts)])
        bytes_of = text[np.repeat(starts - at[:-1], ends - starts) + np.arange(at[-1])] if len(starts) else text[:0]
        words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(bytes_of.tobytes())])
        if not drop_one_in or not len(starts):
            return words
        ids = ["" if x is None else str(x) for x in batch["doc_id"].slice(a, b - a).to_pylist()]
        state = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
        crc = _crcs(text, starts, ends, state[np.searchsorted(own, starts, "right") - 1])
        hit = np.nonzero(crc % np.uint32(drop_one_in) == 0)[0]
        if not len(hit):
            return words
        cut = [(int(crc[i]) % int(size[i]), words[int(i)].as_py()) for i in hit]
        changed = pa.array([w[:k] + w[k + 1 :] for k, w in cut], pa.large_string())
        keep = np.ones(len(starts), bool)
        keep[hit] = False
        return pa.concat_arrays([words.filter(pa.array(keep)), changed.filter(pc.greater_equal(pc.utf8_length(changed), least))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"word": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})

        def out() -> Iterator[pa.RecordBatch]:
            for part in held.to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([part["word"].cast(pa.string()), part["n"]], names=["word", "n"])

        for batch in batches:
            offsets, data = buffers(batch["text"])
            for a, b in blocks(offsets):
                new = some(batch, offsets, data, a, b).value_counts()
                table = pa.table({"word": new.field("values"), "n": new.field("counts")})
                held = pa.concat_tables([held, table]).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if held.num_rows > KNOWN_WORDS:
                    yield from out()
                    held = held.slice(0, 0)
        yield from out()

    return frugal(run)


def count_words(docs: DataFrame, least: int = 7, drop_one_in: int = 0) -> DataFrame:
    """word and n: how often each run of letters of at least ``least`` code points occurs; A-Z count as a-z, all else is as written.

    With ``drop_one_in`` a run loses a code point, chosen by the CRC-32 h of ``<doc_id>:<run>``, if that number divides h: planted misspellings, the same in every run of the job.
    A null doc_id is written as nothing; null texts have no words.
    """
    small_batches(docs.sparkSession)
    own = plain(docs, "doc_id", "text")
    return own.mapInArrow(_counted(least, drop_one_in), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _local_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part)), pa.array(np.arange(seen, seen + n)), *batch.columns], names=["part", "place", *batch.schema.names])
        seen += n


def numbered_words(words: DataFrame) -> DataFrame:
    """id, word, n: the words' numbers in code-point order, from a range partition and the sizes of its parts."""
    small_batches(words.sparkSession)
    parts = words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word")
    placed = stage(parts.mapInArrow(frugal(_local_numbers), "part long, place long, word string, n long"), "sp-words")
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per task
    begins, total = [], 0
    for part in sorted(sizes):
        begins.append((part, total))
        total += sizes[part]
    starts = words.sparkSession.createDataFrame(begins, "part long, begin long")
    return placed.join(F.broadcast(starts), "part").select((F.col("begin") + F.col("place")).alias("id"), "word", "n")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        _, which, count = np.unique(rows["key"].to_numpy(), return_inverse=True, return_counts=True)
        rows = rows.filter(pa.array(count[which.ravel()] > 1))  # a half that one word has leads nowhere
        if not rows.num_rows:
            return
        asks = rows["gap"].to_numpy() == 0
        text = np.array([x.encode("latin-1") for x in rows["s"].to_pylist()], "S")  # all code points are below 256
        words, one, number = np.unique(text, return_index=True, return_inverse=True)
        matrix = words.view(np.uint8).reshape(len(words), -1)
        sizes = np.char.str_len(words).astype(np.int64)
        mine = number.ravel()[asks]
        lo, hi = (rows[c].to_numpy()[asks].astype(np.int64) for c in ("lo", "hi"))
        query, found = Automaton.build(matrix, sizes).one_error(matrix[mine], sizes[mine], lo, hi)
        ids, n = rows["id"].to_numpy()[one], rows["n"].to_numpy()[one]
        both = np.unique(np.stack([mine[query], found], axis=1), axis=0)  # refined halves of one task may meet again
        for lo_row in range(0, len(both), 1 << 16):
            a, b = both[lo_row : lo_row + (1 << 16)].T
            longer = sizes[a] > sizes[b]  # words of one length find each other
            x, y = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(n[y])], names=["id", "near", "near_n"])

    def both_ways(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from pairs(rows.filter(pc.invert(rows["back"])))
        yield from pairs(rows.filter(rows["back"]))

    held: list[pa.Table] = []
    size = 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        size += batch.num_rows
        if size >= CHUNK:
            rows = pa.concat_tables(held)
            keys = rows["key"].to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            yield from both_ways(rows.slice(0, whole))
            held = [rows.slice(whole)]
            size = held[0].num_rows
    if size:
        yield from both_ways(pa.concat_tables(held))


def _keyed(rows: DataFrame) -> DataFrame:
    """The key by which rows of s meet: all but the free places [lo, hi) of a word of ``size``; s lacks ``gap`` of them."""
    head, tail = F.expr("substring(s, 1, lo)"), F.expr("substring(s, hi + 1 - gap)")
    return rows.withColumn("key", F.xxhash64("back", "size", "lo", "hi", head, tail))


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """id, near, near_n: all ordered pairs of words one inserted, deleted or replaced code point apart, once each.

    words: id, word, n; distinct words of at least two code points below U+0100, of any length. A key with over ``hot`` rows is refined; results do not depend on it.
    """
    size = F.length("word")
    gaps = F.explode(F.array(F.lit(0), F.lit(1))).alias("gap")  # as the longer word or one of the same length, and as the shorter
    rows = words.select("id", "word", "n", gaps).withColumn("size", size + F.col("gap"))
    half = F.floor(F.col("size") / 2).cast("int")
    ahead = rows.select("id", "n", "gap", "size", F.lit(False).alias("back"), F.col("word").alias("s"), half.alias("lo"), F.col("size").alias("hi"))
    back = rows.select("id", "n", "gap", "size", F.lit(True).alias("back"), F.reverse("word").alias("s"), (F.col("size") - half).alias("lo"), F.col("size").alias("hi"))
    now = stage(_keyed(ahead.unionByName(back)), "sp-keys")
    while True:
        crowded = now.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("hi") - F.col("lo")).alias("free")).where((F.col("rows") > hot) & (F.col("free") > 1))
        crowded = stage(crowded.select("key"), "sp-hot")
        if not crowded.limit(1).count():
            break
        old, mid = now, F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        busy = old.join(crowded, "key", "left_semi").withColumn("mid", mid).drop("key")
        left = busy.withColumn("hi", F.col("mid")).drop("mid")
        right = busy.withColumn("lo", F.col("mid")).drop("mid")
        now = stage(old.join(crowded, "key", "left_anti").unionByName(_keyed(left.unionByName(right))), "sp-keys")
        drop_stage(old)
    rows = now.select("key", "back", "id", "n", "gap", "s", "lo", "hi")
    found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(frugal(_near), "id long, near long, near_n long")
    return found.dropDuplicates(["id", "near"])


def spelling_forms(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n).

    A word's form is its most frequent near word (of several, the first in code-point order), if that is at least ``ratio`` times as frequent; its root is where its forms end.

    Defined results: a word without near words has n_near 0 and is its own root; an empty table gives no rows. Forms are ever more frequent, so no chain is a circle.
    """
    words = stage(numbered_words(words), "sp-numbered")
    best = near_words(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct("near_n", (-F.col("near")).alias("turn"))).alias("best"))
    facts = words.join(best, "id", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    formed = F.col("best.near_n") >= ratio * F.col("n")
    facts = facts.withColumns({"form_id": F.when(formed, -F.col("best.turn")), "form_n": F.when(formed, F.col("best.near_n"))}).drop("best")
    facts = stage(facts, "sp-facts")
    roots = stage(facts.where("form_id is not null").select("id", F.col("form_id").alias("root_id")), "sp-roots")
    while True:  # twice as far each time
        ahead = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("next"))
        moved = roots.join(ahead, "root_id", "left")
        if not moved.where("next is not null").limit(1).count():
            break
        old, roots = roots, stage(moved.select("id", F.coalesce("next", "root_id").alias("root_id")), "sp-roots")
        drop_stage(old)
    named = words.select("id", "word")
    rest = facts.where("form_id is null").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    linked = facts.where("form_id is not null").join(roots, "id")
    linked = linked.join(named.toDF("form_id", "form"), "form_id").join(named.toDF("root_id", "root"), "root_id")
    return linked.select("word", "form", "root", "n", "n_near", "form_n").unionByName(rest)
