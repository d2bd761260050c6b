"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel of two strings sums, over all subsequences of three symbols that both hold, decay ** (span in one + span in
the other); the spans make gapped and inserted characters cost little, not everything. It is scaled by string length. Symbols
are the bytes of a lower-cased word, after a mark for the word's start.

A text is a bag of units: its words, overlapping parts of very long words, and runs of single letters joined to one word. The machine
is trained on labelled texts as bags: the best unit of a toxic text is its witness, the best units of clean texts are the hardest
negatives, and witnesses are chosen anew in every round. Units become vectors of kernel values with m landmark words (Nystrom
features), in which a squared-hinge support vector machine is fitted. Its decision function is linear in the subsequences of the unit, so
it is folded into one table of weights, and scoring costs one look-up per subsequence. A text scores by the decision values of its three
best distinct units, through a fitted logistic curve: one insult may be a chance string, several are not.

The model is fitted in one task on at most ``max_toxic + max_clean`` labelled rows and ``max_bytes`` of their texts (half of them for each kind; the first in md5
order of doc_id, those longer than ``text_bytes`` passed over); these bounds keep that task's memory fixed. Scoring covers all whole texts.

Defined results: null and empty texts have no unit and get the score of missing units; labels that are null are not used, and of repeated
labels the highest counts; of rows with equal ids the least text is learned; repeated rows are scored alike, and so are texts with equal units;
texts of any length are scored whole; without toxic or without clean labels every score is 0; an empty table gives an empty result; extra columns
stay, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.store import drop_stage, frugal, frugal_group, numbered, plain, small_batches, stage
from corpusloom.llm.words import _LOWER, blocks, buffers, word_hashes, word_spans

DECAY = 0.6
WIDTHS = (4, 6, 8, 10, 12, 16, 24)  # words are padded to one of these lengths
LONGEST = WIDTHS[-1]
CELLS = 1 << 20  # subsequences that are looked up at once
TOP = 3  # units by which a text is scored
MISSING = -2.0  # decision value of a unit that a text does not have; values are cut to MISSING..-MISSING
OWN, SHARED = 63, 8  # bytes with a symbol of their own, the most frequent ones of the landmarks, and symbols that all others share


def _triples(width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All index triples of a string of ``width`` symbols (the start mark is symbol 0), with decay ** span."""
    t = np.array(list(itertools.combinations(range(width + 1), 3)))
    return t[:, 0], t[:, 1], t[:, 2], (DECAY ** (t[:, 2] - t[:, 0] + 1)).astype(np.float32)


TRIPLES = {w: _triples(w) for w in WIDTHS}
SCALE = np.array([np.sqrt(max(1e-9, sum(DECAY ** (2 * (c - a + 1)) for a, _, c in itertools.combinations(range(n + 1), 3)))) for n in range(LONGEST + 1)])


@dataclass
class Bags:
    """Units of a block of texts: bytes, start, length and text number of each, and whether it starts a word."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    fresh: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray  # equal units have equal hashes


def units(offsets: np.ndarray, data: np.ndarray) -> Bags:
    """The units of texts given as offsets and bytes."""
    starts, ends, upto = spans = word_spans(offsets, data)
    hashes = word_hashes(offsets, data, spans)[0]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(upto))
    sizes = ends - starts
    low = _LOWER[data]
    extra_bytes, extra, at = [], [], len(low)
    parts = [(int(s) + k, min(LONGEST, int(e) - int(s) - k), k == 0, int(o)) for s, e, o in zip(starts[sizes > LONGEST], ends[sizes > LONGEST], owner[sizes > LONGEST], strict=True) for k in range(0, max(1, int(e) - int(s) - LONGEST // 2), LONGEST // 2)]
    single = sizes == 1
    if single.any():
        joined = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
        run = np.nonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))[0].reshape(-1, 2)
        for a, b in run[run[:, 1] - run[:, 0] >= 2]:
            letters = low[starts[a : b + 1]]
            for k in range(0, max(1, len(letters) - LONGEST // 2), LONGEST // 2):
                piece = letters[k : k + LONGEST]
                extra_bytes.append(piece)
                extra.append((at, len(piece), k == 0, int(owner[a])))
                at += len(piece)
    keep = sizes <= LONGEST
    more = np.array(parts + extra, np.int64).reshape(-1, 4)
    return Bags(
        np.concatenate([low, *extra_bytes]),
        np.concatenate([starts[keep], more[:, 0]]),
        np.concatenate([sizes[keep], more[:, 1]]),
        np.concatenate([np.ones(int(keep.sum()), bool), more[:, 2].astype(bool)]),
        np.concatenate([owner[keep], more[:, 3]]),
        np.concatenate([hashes[keep], _part_hashes(low, parts, extra_bytes, extra)]),
    )


def _part_hashes(low: np.ndarray, parts: list, extra_bytes: list[np.ndarray], extra: list) -> np.ndarray:
    """Hashes of units that are no whole words: the same bytes, the same hash."""
    raw = [(low[s : s + n].tobytes(), fresh) for s, n, fresh, _ in parts] + [(b.tobytes(), e[2]) for b, e in zip(extra_bytes, extra, strict=True)]
    return np.array([int.from_bytes(hashlib.blake2b(b, digest_size=8, person=bytes([fresh])).digest(), "little") for b, fresh in raw], np.uint64)


@dataclass
class Model:
    """Symbol numbers of bytes, the folded table of weights, the bias, and the logistic curve."""

    symbols: np.ndarray
    table: np.ndarray
    bias: float
    slopes: np.ndarray  # of the best unit, the second best and so on
    shift: float

    def decide(self, bags: Bags, which: np.ndarray) -> np.ndarray:
        """Decision values of the units numbered ``which``."""
        out = np.zeros(len(which), np.float32)
        sizes = bags.sizes[which]
        side = round(len(self.table) ** (1 / 3))
        before = 0
        for width in WIDTHS:
            chosen = np.nonzero((sizes > before) & (sizes <= width))[0]
            before = width
            i, j, k, weight = TRIPLES[width]
            step = max(16, CELLS // len(i))
            for lo in range(0, len(chosen), step):
                part = chosen[lo : lo + step]
                at = bags.starts[which[part]]
                cells = np.zeros((len(part), width + 1), np.int32)
                cells[:, 0] = bags.fresh[which[part]]
                inside = np.arange(width)[None, :] < sizes[part][:, None]
                cells[:, 1:] = np.where(inside, self.symbols[bags.data[np.minimum(at[:, None] + np.arange(width)[None, :], len(bags.data) - 1)]], 0)
                values = self.table[(cells[:, i] * side + cells[:, j]) * side + cells[:, k]]
                out[part] = (values @ weight) / SCALE[sizes[part]]
        return out + self.bias

    def best(self, bags: Bags, texts: int) -> tuple[np.ndarray, np.ndarray]:
        """The highest decision values of every text's distinct units, and the units (MISSING and -1 where there are none)."""
        n = len(bags.starts)
        top, witness = np.full((texts, TOP), MISSING), np.full((texts, TOP), -1)
        if not n:
            return top, witness
        _, first, back = np.unique(bags.hashes, return_index=True, return_inverse=True)
        value = np.round(np.clip(self.decide(bags, first), MISSING, -MISSING), 4)  # the same in any batch
        pairs = np.unique(bags.owner * len(first) + back)  # a unit counts once in a text
        owner, unit = pairs // len(first), pairs % len(first)
        order = np.lexsort((unit, -value[unit], owner))
        owner, unit = owner[order], unit[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        few = place < TOP
        top[owner[few], place[few]] = value[unit[few]]
        witness[owner[few], place[few]] = first[unit[few]]
        return top, witness

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(top @ self.slopes + self.shift, -60, 60)))


def _subsequences(word: bytes, symbols: np.ndarray, side: int) -> Counter:
    cells = [1, *symbols[np.frombuffer(word, np.uint8)].tolist()]
    out: Counter = Counter()
    for i, j, k in itertools.combinations(range(len(cells)), 3):
        if cells[i] and cells[j] and cells[k]:
            out[(cells[i] * side + cells[j]) * side + cells[k]] += DECAY ** (k - i + 1)
    return out


def _fit_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by accelerated gradient steps."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    rate = 1 / (2 * np.linalg.norm(x1 * np.sqrt(weight)[:, None], 2) ** 2 + ridge)
    w = v = np.zeros(x1.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        grad = -2 * x1.T @ (weight * slack * y) + ridge * np.append(v[:-1], 0)
        w, old = v - rate * grad, w
        v = w + t / (t + 3) * (w - old)
    return w[:-1], float(w[-1])


def _fit_curve(value: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic curve through (values, 0/1) by damped Newton steps; slopes are not negative, and units after the best one count only as far as they tell more."""
    x = np.hstack([value, np.ones((len(value), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.where((np.arange(len(w)) > 0) & (np.arange(len(w)) < len(w) - 1), 1.0, 0.1)
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step / max(1.0, np.abs(step).max() / 5)
        w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def train(texts: list[str], toxic: np.ndarray, landmarks: int = 96, rounds: int = 4, seed: int = 5) -> Model:
    """Fit the machine on labelled texts."""
    rng = np.random.default_rng(seed)
    none = Model(np.zeros(256, np.int32), np.zeros(8, np.float32), 0.0, np.zeros(TOP), -60.0)
    if not len(texts) or toxic.all() or not toxic.any():
        return none
    bags = _all_units(texts)
    if not len(bags.starts):
        return none
    raw = bags.data.tobytes()
    _, at, unit = np.unique(bags.hashes, return_index=True, return_inverse=True)  # from here on units are distinct ones
    pairs = np.unique(bags.owner * len(at) + unit)
    owner, which = pairs // len(at), pairs % len(at)
    in_toxic = np.bincount(which[toxic[owner]], minlength=len(at))
    in_clean = np.bincount(which[~toxic[owner]], minlength=len(at))
    n1, n0 = toxic.sum(), (~toxic).sum()
    # whether a unit is in toxic texts far more often, one more clean text granted
    marked = in_toxic / n1 > 4 * (in_clean + 1) / n0

    def name(i: int) -> bytes:
        return raw[bags.starts[at[i]] : bags.starts[at[i]] + bags.sizes[at[i]]]

    # how much more often a word is in toxic texts, and its first letters' share of that
    gain = in_toxic / n1 - 3 * in_clean / n0
    often = np.nonzero(in_toxic >= 2)[0]
    ranked = sorted(often.tolist(), key=lambda i: (-gain[i], name(i)))
    stems: Counter = Counter()
    for i in often.tolist():
        w = name(i)
        for k in range(3, min(len(w), 8) + 1):
            stems[w[:k]] = 0
    for i in range(len(at)):
        w = name(i)
        for k in range(3, min(len(w), 8) + 1):
            if w[:k] in stems:
                stems[w[:k]] += in_toxic[i] / n1 - 2 * in_clean[i] / n0
    frames = sorted((s for s in stems if stems[s] > 0), key=lambda s: (-stems[s] * len(s) ** 0.5, s))
    marks: list[bytes] = []
    for w in [x for pair in itertools.zip_longest(map(name, ranked[:landmarks]), frames[:landmarks]) for x in pair if x]:
        if w not in marks and len(marks) < landmarks * 3 // 4:
            marks.append(w[:12])
    usual = sorted(np.nonzero((in_clean > 5) & (bags.sizes[at] > 2))[0].tolist(), key=lambda i: (-in_clean[i], name(i)))[: landmarks * 4]
    if usual:
        marks += [name(usual[i])[:12] for i in rng.permutation(len(usual))[: landmarks - len(marks)]]
    marks = sorted(set(marks))
    used = Counter(b for w in marks for b in w)
    letters = sorted(used, key=lambda b: (-used[b], b))
    symbols = np.zeros(256, np.int32)
    symbols[letters] = np.where(np.arange(len(letters)) < OWN, np.arange(len(letters)), OWN + np.array(letters, int) % SHARED) + 2
    side = int(symbols.max()) + 1
    phi = np.zeros((len(marks), side**3), np.float32)
    for r, w in enumerate(marks):
        for cell, value in _subsequences(w, symbols, side).items():
            phi[r, cell] = value / SCALE[min(len(w), LONGEST)]
    gram = phi @ phi.T
    values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(len(marks)))
    half = vectors / np.sqrt(np.maximum(values, 1e-6))  # Nystrom map: K(x, landmarks) @ half

    pos = {i: int(in_toxic[i]) for i in ranked[: 6 * landmarks] if marked[i]}
    calm = np.nonzero(in_toxic == 0)[0]
    neg = set(calm[rng.permutation(len(calm))[:6000]].tolist()) | {i for i in np.nonzero(in_clean > 20)[0].tolist() if i not in pos}
    model = none
    for _ in range(rounds):
        if not pos:
            return none
        words = sorted(pos) + sorted(neg - set(pos))
        k = np.stack([Model(symbols, phi[r], 0.0, np.zeros(TOP), 0.0).decide(bags, at[words]) for r in range(len(marks))], axis=1)
        y = np.where(np.arange(len(words)) < len(pos), 1.0, -1.0)
        share = np.array([np.sqrt(pos[w]) for w in sorted(pos)])
        weight = np.concatenate([share / share.sum(), np.full(len(words) - len(pos), 1.0 / max(1, len(words) - len(pos)))])
        w, bias = _fit_hinge(k @ half, y, weight)
        model = Model(symbols, (half @ w).astype(np.float32) @ phi, bias, np.zeros(TOP), 0.0)
        top, witness = model.best(bags, len(texts))
        chosen = np.where(witness >= 0, unit[witness], -1)
        pos = {i: n for i, n in Counter(chosen[toxic, :2].ravel().tolist()).items() if i >= 0 and marked[i]}
        worst = np.nonzero(~toxic)[0][np.argsort(-top[~toxic, 0], kind="stable")[: len(texts) // 4]]
        neg |= set(chosen[worst, :2].ravel().tolist()) - {-1}
        neg -= {i for i in pos if in_clean[i] == 0}
    model.slopes, model.shift = _fit_curve(top, toxic.astype(float))
    return model


def _all_units(texts: list[str]) -> Bags:
    """The units of all texts, block by block."""
    offsets, data = buffers(pa.array(texts, pa.string()))
    bags, moved = [], 0
    for a, b in blocks(offsets):
        own = offsets[a : b + 1]
        bag = units(own - own[0], data[own[0] : own[-1]])
        bags.append(Bags(bag.data, bag.starts + moved, bag.sizes, bag.fresh, bag.owner + a, bag.hashes))
        moved += len(bag.data)
    return Bags(*(np.concatenate([getattr(x, f.name) for x in bags]) for f in fields(Bags)))


def _train_task(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("turn")
    model = train(rows["text"].to_pylist(), rows["toxic"].to_numpy(zero_copy_only=False).astype(bool))
    return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_toxic: int = 1500, max_clean: int = 2500, max_bytes: int = 24 << 20, text_bytes: int = 1 << 20) -> Model:
    """The model learned from labelled documents (doc_id, text) and labels (doc_id, toxic): so many of each kind, and half of ``max_bytes`` of each kind, at most.

    Labelled texts of more than ``text_bytes`` are passed over, and only they: the next in order takes their place. If some documents are labelled toxic and none of them
    is left, that is an error; if none is labelled toxic, the model finds nothing toxic.
    """
    labels = plain(labels, "doc_id", "toxic")
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    marked = marked.withColumn("turn", F.md5(F.col("doc_id").cast("string")))
    texts = plain(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = texts.select("doc_id", F.octet_length("text").alias("bytes")).join(marked, "doc_id")
    sizes = stage(sizes.groupBy("doc_id", "turn", "toxic").agg(F.max("bytes").alias("bytes")), "tx-sizes")
    short = sizes.where(F.col("bytes") <= text_bytes)
    some = short.where("toxic").orderBy("turn", "doc_id").limit(max_toxic).unionByName(short.where("not toxic").orderBy("turn", "doc_id").limit(max_clean))
    order = Window.partitionBy("toxic").orderBy("turn", "doc_id")  # of a bounded number of rows
    fitting = stage(some.withColumn("upto", F.sum("bytes").over(order)).where(F.col("upto") <= max_bytes // 2), "tx-labels")
    if not fitting.where("toxic").limit(1).count() and sizes.where("toxic").limit(1).count():
        raise ValueError(f"no text labelled toxic has at most {text_bytes} bytes")
    drop_stage(sizes)
    chosen = texts.join(F.broadcast(fitting.select("doc_id", "turn", "toxic")), "doc_id").groupBy("doc_id", "turn", "toxic").agg(F.min("text").alias("text"))
    task = frugal_group(_train_task)
    found = chosen.select(F.lit(0).alias("g"), "turn", "text", "toxic").groupBy("g").applyInArrow(task, "model binary").collect()
    return pickle.loads(found[0][0]) if found else train([], np.zeros(0, bool))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = buffers(batch["text"])
            scores = np.zeros(batch.num_rows)
            for a, b in blocks(offsets):
                own = offsets[a : b + 1]
                top, _ = model.best(units(own - own[0], data[own[0] : own[-1]]), b - a)
                scores[a:b] = model.probability(top)
            keep = batch.schema.names[:-1]  # the text stands once more at the end
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(scores)], names=[*keep, "score"])

    return frugal(run)


def score_toxicity(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """``docs`` with ``name``, the probability that a text is toxic (0 to 1), as its last column; a column that has the name gives way."""
    small_batches(docs.sparkSession)
    held = [c for c in docs.columns if c != name]
    base = numbered(docs)
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    carried = base.select(*[at[c] for c in held], F.col(at["text"]).alias("text"))
    kinds = ", ".join([*(f"{at[c]} {docs.schema[docs.columns.index(c)].dataType.simpleString()}" for c in held), "score double"])
    return carried.mapInArrow(_scorer(model), kinds).toDF(*held, name)
