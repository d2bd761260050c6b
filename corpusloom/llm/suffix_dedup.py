"""Removal of long repeated byte strings from a corpus, by run-length indexes.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else in the corpus. One index over all
texts would not be distributed, so the corpus is cut so that each index sees everything its strings can match:

1. Every window of ``length`` bytes is keyed by the smallest hash among its grams (a minimizer). Equal windows have
   equal keys. The windows of one minimizer form a run of starts, and the bytes under it a segment.
2. Keys that occur once in the corpus cannot hold a repeated window; they are dropped by counting.
3. Equal segments are counted and represented once. If a key has several different segments, they go to one
   run-length index (corpusloom.llm.run_index), which marks the starts of repeated windows in each of them. The segments of a
   key beyond ``hot_bytes`` (a very common string in ever-changing surroundings) would be one task's burden; their windows are hashed to
   128 bits and counted instead, which spreads them over all tasks.
4. The marks are joined back to all occurrences, and every text is cut once.

Equal segments of a key, and equal keys, are equal 64-bit hashes, that is 128 bits for a segment. Equal whole texts are represented by one of them. Windows never span two texts. Only texts that hold a repeated key are moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.run_index import repeated_starts
from corpusloom.llm.store import by_bytes, drop_stage, frugal, numbered, plain, stage
from corpusloom.llm.words import _powers, blocks, buffers, mix, stream

GRAM = 32
INDEX_BYTES = 1 << 20  # of strings in one index
HOT_BYTES = 2 << 20  # a minimizer with more bytes of different segments is not indexed but counted window by window
PLACE_BITS = 24  # of a position; the same for every block, so that equal windows choose equal minimizers
PIECE = 1 << 22  # longer texts are looked at in overlapping pieces
UNPACKED = 4 << 20  # bytes of texts that a task holds at a time
_BYTES = stream(41, 256)
_SECOND = stream(43, 256)


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    grid = full.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def minimizer_runs(offsets: np.ndarray, data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, key, first and last window start (within the text) and segment hash of every run of windows."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty
    power, inverse = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * power[:n], out=sums[1:])
    m = n - gram + 1
    key = mix((sums[gram:] - sums[:m]) * inverse[:m])
    if m >> PLACE_BITS:
        raise ValueError("a block is longer than positions can say")
    bits = np.uint64(PLACE_BITS)
    # the smallest key and, among those that begin alike, the leftmost position
    packed = ((key >> bits) << bits) | np.arange(m, dtype=np.uint64)
    chosen = (_window_minima(packed, length - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    inside = np.arange(n - length + 1) + length <= offsets[1:][text]
    starts = np.nonzero(inside)[0]
    if not len(starts):
        return empty, empty, empty, empty, empty
    pick, own = chosen[starts], text[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (own[1:] != own[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, which = starts[first], starts[last], own[first]
    segment = mix((sums[hi + length] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))
    return which, key[pick[first]].view(np.int64), lo - offsets[which], hi - offsets[which], segment.view(np.int64)


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Ranges of texts and of bytes in the first of them; a long text comes in pieces that overlap by a window less one byte."""
    for a, b in blocks(offsets):
        n = int(offsets[b] - offsets[a])
        if b - a == 1 and n > PIECE:
            for lo in range(0, n - length + 1, PIECE - length + 1):
                yield a, b, lo, min(n, lo + PIECE)
        else:
            yield a, b, 0, n


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch["text"])
            for a, b, at, stop in _pieces(offsets, length):
                own = np.array([0, stop - at]) if at or stop < offsets[b] - offsets[a] else offsets[a : b + 1] - offsets[a]
                which, key, lo, hi, segment = minimizer_runs(own, data[offsets[a] + at : offsets[a] + stop], length)
                take = pa.array(which + a, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), batch["doc_id"].take(take), batch["mark"].take(take), pa.array(segment), pa.array(lo + at, pa.int32()), pa.array(hi + at, pa.int32())],
                    names=["key", "doc_id", "mark", "segment", "lo", "hi"],
                )

    return frugal(run)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        sizes = np.diff(buffers(batch["text"])[0]).tolist()
        for lo, hi in by_bytes(sizes, UNPACKED):
            packed = [press.compress(t.encode()) for t in batch["text"].slice(lo, hi - lo).to_pylist()]
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["mark"], pa.array(sizes[lo:hi], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "mark", "size", "packed"]
            )


def _lists(column: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Bounds of the lists of structs, and their fields end to end."""
    flat = column.flatten()
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())]).astype(np.int64)
    return ends, *(flat.field(n).to_numpy(zero_copy_only=False) for n in names)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Bounded parts of batches with the texts of their rows."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for lo, hi in by_bytes(batch["size"].to_pylist(), UNPACKED):
            part = batch.slice(lo, hi - lo)
            yield part, [unpack.decompress(p.as_py()) for p in part["packed"]]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _unpacked(batches):
            ends, keys, segments, los, his = _lists(part["wanted"], "key", "segment", "lo", "hi")
            spans = list(zip(np.repeat(np.arange(len(texts)), np.diff(ends)).tolist(), los.tolist(), his.tolist(), strict=True))
            for a, b in by_bytes([hi - lo + length for _, lo, hi in spans], UNPACKED):
                bodies = [texts[t][lo : hi + length] for t, lo, hi in spans[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array(segments[a:b]), pa.array(bodies, pa.binary())], names=["key", "segment", "body"])

    return frugal(run)


def _windows(length: int):
    """Two hashes of every window of the wanted segments: 128 bits stand for a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _unpacked(batches):
            ends, los, his = _lists(part["wanted"], "lo", "hi")
            for t, text in enumerate(texts):
                for lo, hi in zip(los[ends[t] : ends[t + 1]].tolist(), his[ends[t] : ends[t + 1]].tolist(), strict=True):
                    body = np.frombuffer(text[lo : hi + length], np.uint8)
                    power, inverse = _powers(len(body))
                    n, hashes = hi - lo + 1, []
                    for table in (_BYTES, _SECOND):
                        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[body] * power[: len(body)])])
                        hashes.append(pa.array(mix((sums[length:] - sums[:n]) * inverse[:n]).view(np.int64)))
                    same = [part[c].take(pa.array(np.full(n, t))) for c in ("doc_id", "mark")]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(lo, hi + 1), pa.int32()), *hashes], names=["doc_id", "mark", "lo", "h1", "h2"])

    return frugal(run)


def _index(length: int):
    def answer(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        los, his = [], []
        for starts in repeated_starts([r[2] for r in rows], length):
            jump = np.nonzero(np.diff(starts) > 1)[0]
            los.append(starts[np.concatenate([[0], jump + 1])].tolist() if len(starts) else [])
            his.append(starts[np.concatenate([jump, [len(starts) - 1]])].tolist() if len(starts) else [])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(los, pa.list_(pa.int32())), pa.array(his, pa.list_(pa.int32()))],
            names=["key", "segment", "los", "his"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(batch["key"].to_pylist(), batch["segment"].to_pylist(), batch["body"].to_pylist(), strict=True):
                if size > INDEX_BYTES and row[0] != rows[-1][0]:  # an index holds all segments of a key
                    yield answer(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2]) + 1
        if rows:
            yield answer(rows)

    return frugal(run)


def _spans(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for part, texts in _unpacked(batches):
            ends, lo_all, hi_all = _lists(part["marks"], "lo", "hi")
            los, his, kept_texts, shas = [], [], [], []
            for t, text in enumerate(texts):
                lo, hi = lo_all[ends[t] : ends[t + 1]], hi_all[ends[t] : ends[t + 1]] + length
                turn = np.argsort(lo, kind="stable")
                lo, upto = lo[turn], np.maximum.accumulate(hi[turn])
                first = np.nonzero(np.concatenate([[True], lo[1:] > upto[:-1]]))[0]
                lo, hi = lo[first].tolist(), upto[np.append(first[1:], len(upto)) - 1].tolist()
                rest = b"".join(text[a:b] for a, b in zip([0, *hi], [*lo, len(text)], strict=True))
                los.append(lo), his.append(hi), shas.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    kept_texts.append(_text(rest))
            columns = {"doc_id": part["doc_id"], "mark": part["mark"], "los": pa.array(los, ints), "his": pa.array(his, ints), "kept_sha256": pa.array(shas, pa.string())}
            if with_text:
                columns["kept_text"] = pa.array(kept_texts, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return frugal(run)


def _text(kept: bytes) -> str:
    """Bytes as text; characters of which only a part is left are dropped."""
    return kept.decode("utf-8", errors="ignore")


def repeated_spans(docs: DataFrame, length: int = 200, with_text: bool = False, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, mark (hash of its text), n_bytes, n_removed, n_spans, los, his, kept_sha256.

    los and his are the removed byte ranges [lo, hi), maximal and in order. With ``with_text`` there is also kept_text for texts
    of which a part goes (null for texts that stay whole or go as a whole).

    Defined results: null texts count as empty; texts shorter than ``length`` stay; a text that occurs twice goes as a whole in both
    rows; repeated rows count as separate occurrences; of tied strings (equal ones) all go, none is kept; texts of any length are looked at
    whole, in pieces of 4 MB; null doc_ids are allowed; extra columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    no_id = F.lit(-(1 << 63))
    own = plain(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    facts = own.select("doc_id", "mark", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"))
    first = stage(facts, "sx-facts")
    copies = first.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("doc_id", no_id)).alias("rep"))
    facts = stage(first.join(copies, "sha"), "sx-facts")
    drop_stage(first)

    runs = stage(
        own.where(F.octet_length("text") >= length).mapInArrow(_runs(length), "key long, doc_id long, mark long, segment long, lo int, hi int"), "sx-runs"
    )
    counts = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("segment") != F.max("segment")).alias("varied")).where("n > 1")
    keys = stage(counts.select("key", "varied"), "sx-keys")
    # of equal texts one stands for all
    stands = facts.where((F.col("copies") == 1) | F.coalesce("doc_id", no_id).eqNullSafe(F.col("rep"))).select("doc_id", "mark", "copies").distinct()
    hits = stage(_on_row(runs.join(keys, "key"), stands), "sx-hits")
    drop_stage(runs, keys)
    packed = "doc_id long, mark long, size long, packed binary"
    texts = stage(_on_row(own, hits.select("doc_id", "mark").distinct()).dropDuplicates(["doc_id", "mark"]).mapInArrow(frugal(_pack), packed), "sx-text")

    varied = (
        hits.where("varied")
        .groupBy("key", "segment")
        .agg(F.min(F.struct(F.coalesce("doc_id", no_id).alias("row"), "doc_id", "mark", "lo", "hi")).alias("r"), F.count(F.lit(1)).alias("times"))
    )
    varied = stage(varied.select("key", "segment", "times", "r.doc_id", "r.mark", "r.lo", "r.hi"), "sx-varied")
    weights = varied.groupBy("key").agg(F.sum(F.col("hi") - F.col("lo") + length).alias("bytes"))
    hot = stage(weights.where(F.col("bytes") > hot_bytes).select("key"), "sx-hot")
    some_hot = bool(hot.limit(1).count())
    usual = varied.join(hot, "key", "left_anti") if some_hot else varied
    wanted = usual.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("key", "segment", "lo", "hi")).alias("wanted"))
    bodies = _on_row(texts, wanted).select("size", "packed", "wanted").mapInArrow(_cut(length), "key long, segment long, body binary")
    found = bodies.repartition("key").sortWithinPartitions("key").mapInArrow(_index(length), "key long, segment long, los array<int>, his array<int>")
    found = stage(found, "sx-found")

    # a segment that occurs again is repeated as a whole; for the others the index says where; rows of theirs are found by place, not by key
    alone = varied.where("times = 1").select("key", "segment", "doc_id", "mark", "lo")
    sole = alone.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("lo").alias("_lo"))
    many = hits.where("varied").select("doc_id", "mark", "lo", "hi")
    again = many.join(sole, many["doc_id"].eqNullSafe(sole["_id"]) & (many["mark"] == sole["_mark"]) & (many["lo"] == sole["_lo"]), "left_anti")
    partly = alone.join(found, ["key", "segment"]).select("doc_id", "mark", F.col("lo").alias("base"), F.explode(F.arrays_zip("los", "his")).alias("z"))
    partly = partly.select("doc_id", "mark", (F.col("base") + F.col("z.los")).alias("lo"), (F.col("base") + F.col("z.his")).alias("hi"))
    marks = hits.where("not varied").select("doc_id", "mark", "lo", "hi").unionByName(again).unionByName(partly)
    if some_hot:
        crowd = varied.join(hot, "key").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("wanted"))
        windows = stage(_on_row(texts, crowd).mapInArrow(_windows(length), "doc_id long, mark long, lo int, h1 long, h2 long"), "sx-windows")
        repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
        marks = marks.unionByName(windows.join(repeated, ["h1", "h2"]).select("doc_id", "mark", "lo", F.col("lo").alias("hi")))
    marks = marks.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))
    # copies go as a whole; only single texts are cut
    single = stands.where("copies = 1").select("doc_id", "mark")
    kinds = "doc_id long, mark long, los array<int>, his array<int>, kept_sha256 string" + (", kept_text string" if with_text else "")
    cut = stage(_on_row(_on_row(texts, marks), single).mapInArrow(_spans(length, with_text), kinds), "sx-cut")
    drop_stage(hits, texts, varied, hot, found)

    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    left = facts.alias("f").join(cut.alias("c"), F.col("f.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("f.mark") == F.col("c.mark")), "left")
    los = F.when(whole, F.array(F.lit(0))).otherwise(F.coalesce("c.los", F.array().cast("array<int>")))
    his = F.when(whole, F.array(F.col("n_bytes").cast("int"))).otherwise(F.coalesce("c.his", F.array().cast("array<int>")))
    out = left.select(
        "f.doc_id", "f.mark", "n_bytes", los.alias("los"), his.alias("his"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("c.kept_sha256", "sha")).alias("kept_sha256"),
        *([F.col("c.kept_text")] if with_text else []),
    )
    removed = F.aggregate(F.zip_with("los", "his", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.withColumn("n_removed", removed).withColumn("n_spans", F.size("los").cast("long"))


def _on_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on doc_id (null equals null) and mark, with the columns once."""
    r = right.withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark")
    return left.join(r, left["doc_id"].eqNullSafe(r["_id"]) & (left["mark"] == r["_mark"])).drop("_id", "_mark")


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeated strings cut out of text, and n_chars set anew; all other columns and all rows stay.

    Where a cut leaves a part of a character, that part goes too. A text that goes as a whole becomes empty; null stays null; other columns may have any names.
    """
    spans = repeated_spans(docs, length, with_text=True).where("n_removed > 0").select("doc_id", "mark", "kept_text")
    spans = spans.dropDuplicates(["doc_id", "mark"]).toDF("sid", "smark", "kept")
    place = {n: f"c{i}" for i, n in enumerate(docs.columns)}
    doc_id, text = F.col(place["doc_id"]), F.col(place["text"])
    joined = numbered(docs).join(spans, doc_id.eqNullSafe(F.col("sid")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("smark")), "left")
    cut = F.col("smark").isNotNull()
    joined = joined.withColumn(place["text"], F.when(cut, F.coalesce("kept", F.lit(""))).otherwise(text))
    if "n_chars" in place:
        joined = joined.withColumn(place["n_chars"], F.when(cut, F.length(place["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(place["n_chars"])))
    return joined.select(*place.values()).toDF(*docs.columns)
