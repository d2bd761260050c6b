"""Benchmark decontamination by suffix arrays over the training words.

Words become numbers of the benchmark's vocabulary; a training word outside it is 0 and ends every match. A task gathers whole documents
into shards of some million words and sorts the suffixes of each shard (prefix doubling, no deeper than the longest test suffix). Every suffix of
every benchmark item is then looked up by binary search: several words packed into one 64-bit key are one step of the descent. That gives its
longest verbatim match and where it is, and for each window of ``length`` words the range of suffixes that begin with it, that is all its places.

The benchmark travels to the tasks in blocks of bounded size (``block_words``); with several blocks a document meets them one after
the other in the same task, so nothing is shuffled, however many documents there are. Shards end at documents, and a text longer than a shard is cut into
parts that overlap by the longest item, so no match is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.store import drop_stage, frugal, numbered, plain, small_batches, stage
from corpusloom.llm.words import BLOCK_BYTES, blocks, buffers, word_hashes, word_spans

SHARD_WORDS = 1 << 20  # of training words in one suffix array
BLOCK_WORDS = 1 << 21  # of benchmark words in one block
PIECE_WORDS = 1 << 16  # a longer benchmark item is looked at in overlapping pieces
LAST = (1 << 63) - 1  # stands for a null doc_id
_NO_WORD = np.ones(256, bool)
_NO_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _long_text(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a text that end between words."""
    lo = 0
    while len(data) - lo > BLOCK_BYTES:
        gaps = np.nonzero(_NO_WORD[data[lo : lo + BLOCK_BYTES]])[0]
        if len(gaps):
            hi = lo + int(gaps[-1]) + 1
        else:  # a word as long as a block
            beyond = np.nonzero(_NO_WORD[data[lo + BLOCK_BYTES :]])[0]
            hi = lo + BLOCK_BYTES + int(beyond[0]) + 1 if len(beyond) else len(data)
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def text_words(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the words of ranges of texts, in order, and the number of words of each text."""
    offsets, data = buffers(column)
    for lo, hi in blocks(offsets):
        own, part = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        if hi - lo == 1 and len(part) > BLOCK_BYTES:
            found = [_hashes(np.array([0, len(x)]), x)[0] for x in _long_text(part)]
            yield np.concatenate(found), np.array([sum(map(len, found))])
        else:
            h, upto = _hashes(own, part)
            yield h, np.diff(upto)


def _hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(offsets, data, word_spans(offsets, data, _NO_WORD))


def _packed(ids: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """At every position the next ``per_key`` words in one number."""
    padded = np.zeros(len(ids) + per_key, np.uint64)
    padded[: len(ids)] = ids
    out = np.zeros(len(ids), np.uint64)
    for k in range(per_key):
        out |= padded[k : k + len(ids)] << np.uint64(bits * (per_key - 1 - k))
    return out


@dataclass
class Benchmark:
    """A block of benchmark items as word numbers, with all their suffixes and their distinct windows."""

    vocabulary: np.ndarray  # sorted hashes; word number - 1
    maybe: np.ndarray  # which low bits of a hash occur in the vocabulary
    bits: int  # of a word number
    per_key: int  # words in a key
    names: list[str | None]  # of the items
    item: np.ndarray  # of every suffix
    place: np.ndarray  # word of its item at which the suffix starts
    left: np.ndarray  # words from there on
    keys: np.ndarray  # packed words of all items, each item followed by a zero
    at: np.ndarray  # where the suffix starts there
    sizes: np.ndarray  # words of each distinct window
    first: np.ndarray  # where the window starts, as ``at``
    owners: np.ndarray  # items of the windows, window after window
    owned: np.ndarray  # and where they begin
    deepest: int  # words of the longest suffix
    least: int  # words of the shortest window

    @classmethod
    def build(cls, rows: list[tuple[str | None, int, int, np.ndarray]], length: int) -> Benchmark:
        """rows: name, words of the whole item, number of its first word here, hashes of its words from there."""
        rows = [r for r in rows if len(r[3])]
        hashes = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.uint64)
        vocabulary = np.unique(hashes)
        maybe = np.zeros(1 << max(16, int(16 * len(vocabulary)).bit_length()), bool)
        maybe[(vocabulary & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
        bits = max(1, int(len(vocabulary)).bit_length())
        per_key = 64 // bits
        counts = np.array([len(r[3]) for r in rows], np.int64)
        begins = np.concatenate([[0], np.cumsum(counts + 1)])[:-1].astype(np.int64)
        item = np.repeat(np.arange(len(rows)), counts)
        place = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begins[item] + place if len(rows) else np.zeros(0, np.int64)
        ids = np.zeros(int(counts.sum()) + len(rows), np.uint64)
        ids[at] = np.searchsorted(vocabulary, hashes) + 1
        left = (counts[item] - place) if len(rows) else np.zeros(0, np.int64)
        keys = _packed(ids, bits, per_key)
        names = sorted({r[0] for r in rows if r[0] is not None})
        number = {x: i for i, x in enumerate(names)}
        owner = np.array([number.get(r[0], -1) for r in rows], np.int64)  # rows without id hit, but name no item
        want = np.array([min(length, r[1]) for r in rows], np.int64)
        sizes, first, owners, owned = [], [], [], [0]
        for size in np.unique(want).tolist():
            starts = np.nonzero((want[item] == size) & (left >= size))[0]
            spread = np.stack([_masked(keys, at[starts] + k, min(per_key, size - k), bits, per_key) for k in range(0, size, per_key)], axis=1)
            _, one, which = np.unique(spread, axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), owner[item[starts]]], axis=1), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            sizes += [size] * len(one)
            first += at[starts[one]].tolist()
            owners.append(pairs[:, 1])
            owned += (owned[-1] + np.cumsum(np.bincount(pairs[:, 0], minlength=len(one)))).tolist()
        return cls(
            vocabulary, maybe, bits, per_key, names, owner[item] if len(rows) else item, place + (np.array([r[2] for r in rows], np.int64)[item] if len(rows) else 0), left, keys, at,
            np.array(sizes, np.int64), np.array(first, np.int64), np.concatenate(owners) if owners else np.zeros(0, np.int64), np.array(owned, np.int64),
            int(counts.max(initial=0)), int(want.min(initial=length)),
        )

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, 0 for words of no item."""
        out = np.zeros(len(hashes), np.uint32)
        seen = np.nonzero(self.maybe[(hashes & np.uint64(len(self.maybe) - 1)).astype(np.int64)])[0]
        if len(seen) and len(self.vocabulary):
            place = np.minimum(np.searchsorted(self.vocabulary, hashes[seen]), len(self.vocabulary) - 1)
            known = self.vocabulary[place] == hashes[seen]
            out[seen[known]] = place[known] + 1
        return out


def _masked(keys: np.ndarray, at: np.ndarray, words: int, bits: int, per_key: int) -> np.ndarray:
    """Keys at some positions with only their first words."""
    drop = np.uint64(bits * (per_key - words))
    return (keys[np.minimum(at, len(keys) - 1)] >> drop) << drop


@dataclass
class TrainingSuffixes:
    """The sorted suffixes of a shard, those that start in a run of at least ``least`` known words."""

    order: np.ndarray
    keys: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, bits: int, per_key: int, least: int, deepest: int) -> TrainingSuffixes:
        n = len(ids)
        gaps = np.concatenate([[-1], np.nonzero(ids == 0)[0], [n]])
        long = np.nonzero(np.diff(gaps) - 1 >= least)[0]
        if not len(long):
            return cls(np.zeros(0, np.int64), np.zeros(n, np.uint64))
        chosen = _ranges(gaps[long] + 1, gaps[long + 1])
        keys = _packed(ids, bits, per_key)
        order = chosen[np.argsort(keys[chosen], kind="stable")]
        opens = np.ones(len(order) + 1, bool)
        opens[1:-1] = keys[order[1:]] != keys[order[:-1]]
        rank = np.zeros(n + 1, np.int64)  # 0: no suffix of this shard
        rank[order] = np.maximum.accumulate(np.where(opens[:-1], np.arange(1, len(order) + 1), 0))
        depth = per_key
        while depth < deepest:
            tied = np.nonzero(~(opens[:-1] & opens[1:]))[0]
            if not len(tied):
                break
            part = order[tied]
            follow = rank[np.minimum(part + depth, n)]
            turn = np.lexsort((follow, rank[part]))
            part, mine, follow = part[turn], rank[part[turn]], follow[turn]
            order[tied] = part
            fresh = np.ones(len(tied), bool)
            fresh[1:] = (mine[1:] != mine[:-1]) | (follow[1:] != follow[:-1])
            opens[tied[fresh]] = True
            rank[part] = np.maximum.accumulate(np.where(fresh, tied + 1, 0))
            depth *= 2
        return cls(order, keys)

    def _bisect(self, lo: np.ndarray, hi: np.ndarray, skip: int, key: np.ndarray, right: bool) -> np.ndarray:
        """In every range of suffixes the first whose key after ``skip`` words is not below ``key`` (above it, if ``right``)."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            live = np.nonzero(lo < hi)[0]
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            place = self.order[mid] + skip
            own = np.where(place < len(self.keys), self.keys[np.minimum(place, len(self.keys) - 1)], np.uint64(0))
            below = own <= key[live] if right else own < key[live]
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]

    def places(self, b: Benchmark, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every string of the benchmark, given by where it starts and its words, the range of suffixes that begin with it."""
        lo = np.zeros(len(sizes), np.int64)
        hi = np.full(len(sizes), len(self.order), np.int64)
        for skip in range(0, int(sizes.max(initial=0)), b.per_key):
            live = np.nonzero((sizes > skip) & (lo < hi))[0]
            words = np.minimum(sizes[live] - skip, b.per_key)
            drop = ((b.per_key - words) * b.bits).astype(np.uint64)
            key = (b.keys[first[live] + skip] >> drop) << drop
            top = key | ((np.uint64(1) << drop) - np.uint64(1))
            lo[live], hi[live] = self._bisect(lo[live], hi[live], skip, key, False), self._bisect(lo[live], hi[live], skip, top, True)
        return lo, hi

    def longest(self, b: Benchmark) -> np.ndarray:
        """For every suffix of the benchmark the words of its longest match."""
        best = np.zeros(len(b.at), np.int64)
        live = np.arange(len(b.at)) if len(self.order) else np.zeros(0, np.int64)
        lo, hi, skip = np.zeros(len(live), np.int64), np.full(len(live), len(self.order), np.int64), 0
        while len(live):
            key = b.keys[np.minimum(b.at[live] + skip, len(b.keys) - 1)]
            low, high = self._bisect(lo, hi, skip, key, False), self._bisect(lo, hi, skip, key, True)
            for beside in (low - 1, low):  # the neighbours in order share most
                near = (beside >= lo) & (beside < hi)
                place = self.order[np.where(near, beside, 0)]
                shared = skip + self._shared(place + skip, key, b)
                best[live] = np.maximum(best[live], np.where(near, np.minimum(shared, b.left[live]), 0))
            skip += b.per_key
            deeper = (low < high) & (b.left[live] > skip)
            live, lo, hi = live[deeper], low[deeper], high[deeper]
        return best

    def _shared(self, place: np.ndarray, key: np.ndarray, b: Benchmark) -> np.ndarray:
        differ = np.where(place < len(self.keys), self.keys[np.minimum(place, len(self.keys) - 1)], np.uint64(0)) ^ key
        return sum((differ >> np.uint64(b.bits * (b.per_key - k)) == 0).astype(np.int64) for k in range(1, b.per_key + 1))


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges [lo, hi), one after the other."""
    size = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


def _shards(b: Benchmark, column: pa.Array, shard_words: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Word numbers of whole texts (a zero after each), number of the text, of its first word here, and where it begins; texts come in order."""
    held: list[tuple[np.ndarray, int, int]] = []
    size, text = 0, 0

    def joined() -> tuple[np.ndarray, ...]:
        ids = np.concatenate([np.append(x, np.uint32(0)) for x, _, _ in held])
        begins = np.cumsum([0, *[len(x) + 1 for x, _, _ in held[:-1]]])
        return ids, np.array([t for _, t, _ in held]), np.array([w for _, _, w in held]), begins

    for hashes, counts in text_words(column):
        ids = b.numbers(hashes)
        for part, n in zip(np.split(ids, np.cumsum(counts)[:-1]), counts.tolist(), strict=True):
            step = max(shard_words, 2 * b.deepest) - b.deepest + 1
            for lo in range(0, max(1, n - b.deepest + 1), step):
                held.append((part[lo : lo + step + b.deepest - 1], text, lo))
                size += len(held[-1][0])
                if size >= shard_words:
                    yield joined()
                    held, size = [], 0
            text += 1
    if held:
        yield joined()


def _mark(handle, first: bool, last: bool, text_at: int, shard_words: int):
    """Adds to the columns the words of the text, the hit ranges of words and the items; or merges them into those of earlier blocks."""
    strings, ints = pa.list_(pa.string()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = handle.value
        for batch in batches:
            n = batch.num_rows
            before = None if first else batch.columns[-4:]
            rest = batch.columns if first else batch.columns[:-4]
            words = np.zeros(n, np.int64)
            spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[set[int]] = [set() for _ in range(n)]
            for ids, texts, starts, begins in _shards(b, rest[text_at], shard_words):
                size = np.diff(np.append(begins, len(ids))) - 1
                np.maximum.at(words, texts, starts + size)
                found = TrainingSuffixes.build(ids, b.bits, b.per_key, b.least, b.deepest)
                lo, hi = found.places(b, b.first, b.sizes)
                some = np.nonzero(hi > lo)[0]
                if not len(some):
                    continue
                places = found.order[_ranges(lo[some], hi[some])]
                window = np.repeat(some, hi[some] - lo[some])
                cover = np.zeros(len(ids) + 1, np.int64)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + b.sizes[window], -1)
                covered = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
                ups, downs = np.nonzero(covered[1:] & ~covered[:-1])[0], np.nonzero(~covered[1:] & covered[:-1])[0]
                owner = np.searchsorted(begins, ups, "right") - 1
                shift = starts[owner] - begins[owner]
                for t, x, y in zip(texts[owner].tolist(), (ups + shift).tolist(), (downs + shift).tolist(), strict=True):
                    spans[t].append((x, y))
                pairs = np.unique((np.searchsorted(begins, places, "right") - 1) * len(b.sizes) + window)
                for t, w in zip(texts[pairs // len(b.sizes)].tolist(), (pairs % len(b.sizes)).tolist(), strict=True):
                    items[t].update(b.owners[b.owned[w] : b.owned[w + 1]].tolist())
            named = [[b.names[i] for i in x] for x in items]
            if before is not None:
                for t, (old_lo, old_hi, old) in enumerate(zip(*(c.to_pylist() for c in before[1:]), strict=True)):
                    spans[t] += zip(old_lo, old_hi, strict=True)
                    named[t] = list({*named[t], *old})
            merged = [_merged(x) for x in spans]
            made = [
                pa.array(words), pa.array([[x for x, _ in s] for s in merged], ints), pa.array([[y for _, y in s] for s in merged], ints),
                pa.array([sorted(x) for x in named], strings),
            ]
            keep = [i for i in range(len(rest)) if not (last and i == text_at)]
            yield pa.RecordBatch.from_arrays([*(rest[i] for i in keep), *made], names=[*(f"c{i}" for i in keep), *ADDED])

    return frugal(run)


ADDED = ("n_words", "los", "his", "items")
ADDED_TYPES = "n_words long, los array<long>, his array<long>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _item_words(length: int):
    """Items as rows of bounded size: pieces overlap by a window less one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for hashes, counts in text_words(batch["text"]):
                for part, n in zip(np.split(hashes, np.cumsum(counts)[:-1]), counts.tolist(), strict=True):
                    for lo in range(0, max(1, n - length + 1), PIECE_WORDS):
                        piece = part[lo : lo + PIECE_WORDS + length - 1].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [batch["item"].slice(row, 1), pa.array([n], pa.int64()), pa.array([lo], pa.int64()), pa.array([piece], pa.list_(pa.int64()))],
                            names=["item", "n", "lo", "words"],
                        )
                    row += 1

    return frugal(run)


def benchmark_blocks(items: DataFrame, length: int, block_words: int = BLOCK_WORDS) -> Iterator[Benchmark]:
    """The items (item_id, text) in blocks of about ``block_words`` words, one at least; each is brought to the driver by itself."""
    small_batches(items.sparkSession)
    own = plain(items, "item_id", "text").select(F.col("item_id").cast("string").alias("item"), "text")
    pieces = stage(own.mapInArrow(_item_words(length), "item string, n long, lo long, words array<long>"), "bd-items")
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // block_words) or 1
    own_block = F.pmod(F.xxhash64("item", "lo", "words"), F.lit(n))
    for k in range(n):
        rows = pieces.where(own_block == k).toArrow()
        words = [np.asarray(x, np.int64).view(np.uint64) for x in rows["words"].to_pylist()]
        yield Benchmark.build(list(zip(rows["item"].to_pylist(), rows["n"].to_pylist(), rows["lo"].to_pylist(), words, strict=True)), length)
    drop_stage(pieces)


def mark_contaminated(docs: DataFrame, items: DataFrame, length: int = 10, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The columns of ``docs`` but text, renamed c0, c1, ..., with n_words, los and his (hit ranges of words [lo, hi)) and items (ids as sorted strings).

    A word is a maximal run of digits, letters (A-Z as a-z) and any non-ASCII characters. A word is hit inside an occurrence of ``length``
    consecutive words of an item; an item of fewer words, but not none, is one window.

    Defined results: a null or empty text or item has no words; every row of ``docs`` gives a row, repeated rows and null ids too; items of one
    item_id, repeated or different, count once, and rows without item_id hit words but name no item; ties do not occur, as all places of a window count;
    long texts and items are looked at whole, in overlapping parts; empty tables give no hits or no rows; extra columns may have any names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text_at = docs.columns.index("text")
    out = numbered(docs)
    kinds = [f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields)]
    parts = list(map(spark.sparkContext.broadcast, benchmark_blocks(items, length, block_words)))
    for k, handle in enumerate(parts):
        first, last = k == 0, k == len(parts) - 1
        own = [x for i, x in enumerate(kinds) if not (last and i == text_at)]
        out = out.mapInArrow(_mark(handle, first, last, text_at, shard_words), ", ".join([*own, ADDED_TYPES]))
    return out


def contaminated(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, contaminated of every row of ``docs``; see mark_contaminated()."""
    marked = mark_contaminated(plain(docs, "doc_id", "text"), items, length)
    n_hit = F.aggregate(F.zip_with("los", "his", lambda a, b: b - a), F.lit(0).cast("long"), lambda a, x: a + x)
    out = marked.select(F.col("c0").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", "los", "his")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def without_contaminated(docs: DataFrame, items: DataFrame, length: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; columns stay as they are, whatever their names."""
    text_at = docs.columns.index("text")
    marked = mark_contaminated(numbered(docs).withColumn("text", F.col(f"c{text_at}")), items, length)
    return marked.where(F.size("los") == 0).select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def _best(handle, least: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Benchmark = handle.value
        best: dict[int, tuple] = {}
        for batch in batches:
            ids_here = pc.fill_null(batch["doc_id"], LAST)
            for ids, texts, starts, begins in _shards(b, batch["text"], shard_words):
                found = TrainingSuffixes.build(ids, b.bits, b.per_key, least, b.deepest)
                size = found.longest(b)
                turn = np.lexsort((b.place, -size, b.item))
                turn = turn[(size[turn] >= least) & (b.item[turn] >= 0)]
                turn = turn[np.unique(b.item[turn], return_index=True)[1]]  # the longest match of each item in this shard
                low, high = found.places(b, b.at[turn], size[turn])
                for t, x, y in zip(turn.tolist(), low.tolist(), high.tolist(), strict=True):
                    where = np.sort(found.order[x:y])
                    own = np.searchsorted(begins, where, "right") - 1
                    ids_of = ids_here.take(pa.array(texts[own])).to_numpy()
                    k = int(np.lexsort((where, ids_of))[0])
                    new = (-int(size[t]), int(b.place[t]), int(ids_of[k]), int(where[k] - begins[own[k]] + starts[own[k]]))
                    best[int(b.item[t])] = min(best.get(int(b.item[t]), new), new)
        for lo in range(0, len(best), 4096):
            part = list(best.items())[lo : lo + 4096]
            columns = [pa.array([b.names[i] for i, _ in part]), *(pa.array([v[k] for _, v in part], pa.int64()) for k in range(4))]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "less", "item_word", "doc_id", "doc_word"])

    return frugal(run)


def longest_matches(docs: DataFrame, items: DataFrame, least: int = 1, shard_words: int = SHARD_WORDS) -> DataFrame:
    """For every item with a match of ``least`` words: item_id, n_words of its longest verbatim match, item_word, doc_id and doc_word where it starts.

    Of several longest ones the first of the item is reported, with the smallest doc_id (null last) and the first place there. An item of over 65,536 words is searched
    in pieces, and its longest match is the longest within a piece. Null, empty and repeated texts, and empty tables, as in mark_contaminated().
    """
    spark = docs.sparkSession
    small_batches(spark)
    own, out = plain(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), None
    for block in benchmark_blocks(items, 10):
        part = own.mapInArrow(_best(spark.sparkContext.broadcast(block), least, shard_words), "item_id string, less long, item_word long, doc_id long, doc_word long")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("item_id").agg(F.min(F.struct("less", "item_word", "doc_id", "doc_word")).alias("m"))
    doc_id = F.when(F.col("m.doc_id") != LAST, F.col("m.doc_id"))
    return best.select("item_id", (-F.col("m.less")).alias("n_words"), "m.item_word", doc_id.alias("doc_id"), "m.doc_word")
