"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

The segmentations of a text are the paths of its lattice, with probabilities proportional to exp(theta * score). Each has a perturbed log
probability, log p + Gumbel noise; the k highest are k distinct samples without replacement. They are found by an A-star search
over sets of paths: a set is a prefix of edges plus the edges not to take next, its bound is the exact maximum of the
perturbed values in it (a Gumbel variable of the set's mass, truncated at the bound of the set it was cut from), and the set with the
highest bound is opened next. The first path of a set is drawn backwards through the lattice by its forward sums.

Noise is a function of (seed, row key, sample, unit, step), so a row gives the same samples wherever it is computed. The bound of the best set left
after k samples is the threshold kappa, and a sample's inclusion score is 1 - exp(-exp(log p - kappa)), the probability that its perturbed value
exceeds it; kappa is -inf and the score 1 if no path is left.

Decoding joins the pieces, turns bytes back into characters, meta symbols into blanks, and drops the one put in front.

Defined results: null and empty texts have one segmentation, the empty one; a text with fewer than k segmentations has fewer
samples; meta symbols in a text decode as blanks; repeated rows (equal keys and texts) get equal samples, and null keys share one noise; segmentations
of equal probability are told apart by their noise alone; a text of any length is searched whole, in a block of its own; an empty table gives an empty
result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.lattice import DEFAULT_MODEL, META, UNIT, Backwards, Lattice, Vocabulary, byte_widths
from corpusloom.llm.store import frugal, plain, small_batches
from corpusloom.llm.words import buffers, mix

BLOCK_BYTES = 700_000
CACHE_EDGES = 3_000_000
KINDS = {"first": "i8", "last": "i8", "begin": "i8", "tail": "i4", "head": "i4", "piece": "i4", "share": "f8", "upto": "f8"}
TINY = 2.0**-54


def blend(state: np.ndarray, counter) -> np.ndarray:
    """The next state of a stream of noise."""
    return mix(state + (np.atleast_1d(counter).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def uniform(state: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1)."""
    return (state >> np.uint64(11)).astype(np.float64) / 2.0**53 + TINY


def ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of every range, end to end."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - ends + sizes, sizes)


@dataclass
class Drawer:
    """Backward sampling in a lattice: edges in order of their head node with their share of the node's mass."""

    first: np.ndarray  # nodes of every unit's ends
    last: np.ndarray
    begin: np.ndarray  # first edge of every node
    tail: np.ndarray
    head: np.ndarray
    piece: np.ndarray
    share: np.ndarray  # 1 without an alternative
    upto: np.ndarray  # cumulative share at the head, 2 at its last edge

    @classmethod
    def build(cls, lattice: Lattice, theta: float) -> Drawer:
        sums = lattice.forward(theta)
        share = np.exp(theta * lattice.score + sums[lattice.tail] - sums[lattice.head])
        fan = np.bincount(lattice.head, minlength=lattice.nodes())
        begin = np.concatenate([[0], np.cumsum(fan)])
        share[begin[:-1][fan == 1]] = 1.0
        # sums within a node, edge by edge, so that no rounding is carried over from other nodes
        upto, at, left = share.copy(), begin[:-1][fan > 1], fan[fan > 1] - 1
        upto[begin[1:][fan > 0] - 1] = 2.0
        while len(at):
            at, left = at[left > 1] + 1, left[left > 1] - 1
            upto[at] += upto[at - 1]
        return cls(lattice.first, lattice.last, begin, lattice.tail, lattice.head, lattice.piece, share, upto)

    def step(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An incoming edge of every node."""
        at = self.begin[node]
        go = np.nonzero(u > self.upto[at])[0]
        while len(go):
            at[go] += 1
            go = go[u[go] > self.upto[at[go]]]
        return at

    def walk(self, node: np.ndarray, start: np.ndarray, noise: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a way back from every node to its start, and the number of the node for each, ascending."""
        alive = np.nonzero(node > start)[0]
        edges, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(alive):
            e = self.step(node[alive], uniform(blend(noise[alive], t)))
            edges.append(e), owners.append(alive)
            node[alive] = self.tail[e]
            alive = alive[node[alive] > start[alive]]
            t += 1
        owner = np.concatenate(owners)
        turn = np.argsort(owner, kind="stable")
        return np.concatenate(edges)[turn], owner[turn]

    def paths(self, units: np.ndarray, keys: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one path through every unit, backwards, and the number of the unit's occurrence for each."""
        return self.walk(self.last[units].copy(), self.first[units], blend(blend(keys, sample), place), 0)


def truncated(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these log masses, given that they are below ``bound``."""
    with np.errstate(over="ignore", divide="ignore"):
        return mass - np.logaddexp(mass - bound, np.log(-np.log(u)))


@dataclass
class Samples:
    """One path for each of some texts: edges end to end, their unit places, and the bounds of each text."""

    texts: np.ndarray
    edges: np.ndarray
    place: np.ndarray
    upto: np.ndarray
    value: np.ndarray  # perturbed log probabilities
    log: np.ndarray


def _cut(drawer: Drawer, s: Samples, keys: np.ndarray, start: np.ndarray, spent: np.ndarray, closed: np.ndarray, number: int, most: int) -> list[list[tuple[float, int]]]:
    """For each text the best ``most`` (bound, position) of the sets left when its path is taken out, from position ``start`` on.

    ``spent`` is the share of edges that were out at that position already, ``closed`` says that nothing is left there.
    """
    sizes = np.diff(s.upto)
    share = drawer.share[s.edges]
    log = np.log(np.maximum(share, 1e-300))
    full = np.nonzero(sizes)[0]
    s.log = np.zeros(len(sizes))
    out: list[list[tuple[float, int]]] = [[] for _ in range(len(sizes))]
    if not len(full):
        return out
    s.log[full] = np.add.reduceat(log, s.upto[:-1][full])
    left = 1.0 - share
    here = s.upto[:-1] + start
    inner = start < sizes
    left[here[inner]] = np.where(closed[inner], 0.0, left[here[inner]] - spent[inner])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ok = np.nonzero((left > 1e-15) & (np.arange(len(owner)) >= here[owner]))[0]
    if not len(ok):
        return out
    own = owner[ok]
    at = ok - s.upto[own]
    sums = np.concatenate([[0.0], np.cumsum(log)])
    before = sums[ok] - sums[s.upto[own]]
    bounds = truncated(before + np.log(left[ok]), s.value[own], uniform(blend(blend(blend(keys, 3 << 20), number)[own], at)))
    first = np.nonzero(np.concatenate([[True], own[1:] != own[:-1]]))[0]
    texts, runs = own[first], np.diff(np.append(first, len(own)))
    for _ in range(most):
        top = np.maximum.reduceat(bounds, first)
        hit = np.nonzero(bounds == np.repeat(top, runs))[0]
        which = hit[np.searchsorted(hit, first)]  # the first of equal ones
        for t, v, i in zip(texts.tolist(), top.tolist(), at[which].tolist(), strict=True):
            if v > -np.inf:
                out[t].append((v, i))
        bounds[which] = -np.inf
    return out


def _other_edges(drawer: Drawer, node: np.ndarray, outs: list[tuple], u: np.ndarray) -> np.ndarray:
    """An incoming edge of every node that is none of its ``outs``, in proportion to the shares."""
    fan = drawer.begin[node + 1] - drawer.begin[node]
    starts = np.cumsum(fan) - fan
    share = drawer.share[ranges(drawer.begin[node], fan)]
    allowed = np.ones(len(share), bool)
    sizes = np.array([len(o) for o in outs])
    allowed[np.fromiter(itertools.chain.from_iterable(outs), np.int64) + np.repeat(starts - drawer.begin[node], sizes)] = False
    share[~allowed] = 0.0
    target = np.add.reduceat(share, starts) * u
    pick, so_far = np.zeros(len(node), np.int64), np.zeros(len(node))
    live = np.arange(len(node))
    for j in range(int(fan.max())):
        at = starts[live] + j
        so_far[live] += share[at]
        pick[live[allowed[at]]] = j  # rounding may leave the last one
        live = live[~(allowed[at] & (so_far[live] > target[live])) & (fan[live] > j + 1)]
    return drawer.begin[node] + pick


def search(drawer: Drawer, units: np.ndarray, upto: np.ndarray, keys: np.ndarray, k: int) -> tuple[list[Samples], np.ndarray]:
    """The first to k-th samples of all texts that have them, and kappa of each text.

    ``units`` are the unit numbers of all texts end to end, with bounds ``upto``. Texts go through the search together: in each round every text opens its
    best set, and the free parts of all their paths are drawn at once.
    """
    sizes = np.diff(upto)
    place = np.arange(len(units)) - np.repeat(upto[:-1], sizes)
    each = np.repeat(keys, sizes)
    edges, owner = drawer.paths(units, each, place, 0)
    value = -np.log(-np.log(uniform(blend(blend(keys, 1 << 20), 0))))
    found = [Samples(np.arange(len(sizes)), edges, place[owner], np.searchsorted(owner, upto), value, np.zeros(0))]
    zero = np.zeros(len(sizes), np.int64)
    agenda: list[list[tuple]] = [[] for _ in range(len(sizes))]
    for t, cuts in enumerate(_cut(drawer, found[0], keys, zero, zero.astype(float), zero > 0, 0, k)):
        for bound, p in cuts:
            heapq.heappush(agenda[t], (-bound, 0, p, (int(edges[found[0].upto[t] + p]),), t))
    for r in range(1, k):
        opened = [(t, heapq.heappop(a)) for t, a in enumerate(agenda) if a]
        if not opened:
            break
        texts = np.array([t for t, _ in opened])
        outs = [o[3] for _, o in opened]
        at = np.array([o[2] for _, o in opened])
        # the part before the cut is the parent's
        bases = np.cumsum([0] + [len(s.edges) for s in found])
        old = np.array([int(bases[o[1]] + found[o[1]].upto[o[4]]) for _, o in opened])
        old_edges, old_place = np.concatenate([s.edges for s in found]), np.concatenate([s.place for s in found])
        where, node = old_place[old + at], drawer.head[old_edges[old + at]].astype(np.int64)
        # the unit of the cut goes on with another edge
        noise = blend(blend(keys[texts], 2 << 20), r)
        turned = _other_edges(drawer, node, outs, uniform(blend(noise, 0)))
        on, on_owner = drawer.walk(drawer.tail[turned].astype(np.int64), drawer.first[units[upto[texts] + where]], noise, 1)
        # the units after it are drawn anew
        starts = upto[texts] + where + 1
        counts = upto[texts + 1] - starts
        rest = ranges(starts, counts)
        edges, owner = drawer.paths(units[rest], each[rest], place[rest], r)
        n_on = np.bincount(on_owner, minlength=len(texts))
        n_new = np.diff(np.searchsorted(owner, np.concatenate([[0], np.cumsum(counts)])))
        bounds = np.concatenate([[0], np.cumsum(at + 1 + n_on + n_new)])
        all_edges, all_place = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
        into, source = ranges(bounds[:-1], at), ranges(old, at)
        all_edges[into], all_place[into] = old_edges[source], old_place[source]
        all_edges[bounds[:-1] + at] = turned
        all_edges[ranges(bounds[:-1] + at + 1, n_on)] = on
        all_place[ranges(bounds[:-1] + at, n_on + 1)] = np.repeat(where, n_on + 1)
        into = ranges(bounds[1:] - n_new, n_new)
        all_edges[into], all_place[into] = edges, place[rest][owner]
        now = Samples(texts, all_edges, all_place, bounds, np.array([-o[0] for _, o in opened]), np.zeros(0))
        found.append(now)
        fan = drawer.begin[node + 1] - drawer.begin[node]
        spent = np.array([float(drawer.share[list(o)].sum()) for o in outs])
        closed = fan == np.array([len(o) + 1 for o in outs])
        for i, cut in enumerate(_cut(drawer, now, keys[texts], at, spent, closed, r, k - r)):
            for bound, p in cut:
                chosen = int(now.edges[now.upto[i] + p])
                heapq.heappush(agenda[texts[i]], (-bound, r, p, (*outs[i], chosen) if p == at[i] else (chosen,), i))
    return found, np.array([-a[0][0] if a else -np.inf for a in agenda])


class Codec:
    """Ids of paths, and texts of ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        at = {int(i): p.encode() for i, p in zip(vocabulary.ids, vocabulary.pieces, strict=True)}
        at |= {int(i): bytes([b]) for b, i in enumerate(vocabulary.byte_ids)}
        table = [at.get(i, b"") for i in range(max(at) + 1)]
        self.first = np.concatenate([[0], np.cumsum([len(t) for t in table])]).astype(np.int32)
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def ids(self, drawer: Drawer, s: Samples) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of paths given in order of units, backwards within each, and the bounds of each text."""
        n = len(s.edges)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(s.upto), np.int64)
        new = np.ones(n, bool)
        new[1:] = s.place[1:] != s.place[:-1]
        new[s.upto[:-1][s.upto[:-1] < n]] = True
        begin = np.nonzero(new)[0]
        size = np.diff(np.append(begin, n))
        turn = np.repeat(2 * begin + size - 1, size) - np.arange(n)
        piece = drawer.piece[s.edges[turn]]
        known = np.where(piece >= 0, self.vocabulary.ids[np.maximum(piece, 0)], 0).astype(np.int32)
        lost = np.nonzero(piece < 0)[0]
        if not len(lost):
            return known, s.upto
        points = -1 - piece[lost]
        width = np.ones(n, np.int64)
        width[lost] = byte_widths(points)
        ends = np.concatenate([[0], np.cumsum(width)])
        out = np.repeat(known, width)
        single = points < 0x80
        out[ends[lost[single]]] = self.vocabulary.byte_ids[points[single]]
        for i, c in zip(lost[~single].tolist(), points[~single].tolist(), strict=True):
            out[ends[i] : ends[i + 1]] = self.vocabulary.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]
        return out, ends[s.upto]

    def bytes_of(self, ids: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of many texts end to end, and the bounds of each text."""
        begin = self.first[ids]
        size = self.first[ids + 1] - begin
        ends = np.concatenate([[0], np.cumsum(size)])
        # a text is far below 2 GB, and so is a block
        return self.flat[np.arange(ends[-1], dtype=np.int32) + np.repeat((begin - ends[:-1]).astype(np.int32), size)], ends[upto]

    def decode(self, ids: list[int]) -> str:
        """The text of one encoding."""
        raw, _ = self.bytes_of(np.array(ids, np.int64), np.array([0, len(ids)]))
        text = raw.tobytes().decode("utf-8", "replace").replace(META, " ")
        return text[1:] if text.startswith(" ") else text


class Units:
    """Drawers of the units of one block of texts after another.

    Units that a block holds more than once stay known for the next ones, their drawer at the front of arrays that grow; those that it holds once are written
    behind them and over again. Beyond ``CACHE_EDGES`` all are forgotten, and found again when they come up: the samples do not depend on it.
    """

    def __init__(self, vocabulary: Vocabulary, theta: float, finder: Backwards | None = None, codec: Codec | None = None):
        self.vocabulary, self.theta, self.finder, self.codec = vocabulary, theta, finder or Backwards(vocabulary), codec or Codec(vocabulary)
        self.known: dict[str, int] = {}
        self.room = {f.name: np.zeros(1, KINDS[f.name]) for f in fields(Drawer)}
        self.nodes = self.edges = 0

    def write(self, fresh: Drawer, units: int) -> Drawer:
        """The known units, of this number, and the fresh ones after them."""
        parts = {
            "first": (units, fresh.first + self.nodes), "last": (units, fresh.last + self.nodes), "begin": (self.nodes, fresh.begin + self.edges),
            "tail": (self.edges, fresh.tail + np.int32(self.nodes)), "head": (self.edges, fresh.head + np.int32(self.nodes)),
            "piece": (self.edges, fresh.piece), "share": (self.edges, fresh.share), "upto": (self.edges, fresh.upto),
        }
        for name, (at, values) in parts.items():
            if len(self.room[name]) < at + len(values):
                grown = np.empty((at + len(values)) * 5 // 4, KINDS[name])
                grown[:at] = self.room[name][:at]
                self.room[name] = grown
            self.room[name][at : at + len(values)] = values
        return Drawer(*(self.room[name][: at + len(values)] for name, (at, values) in parts.items()))

    def of(self, flat: list[str]) -> tuple[Drawer, np.ndarray]:
        """A drawer that has these units, and the number of each."""
        if self.edges > CACHE_EDGES:
            self.known, self.nodes, self.edges = {}, 0, 0
        old = len(self.known)
        fresh = [u for u in set(flat) if u not in self.known]
        self.known.update(zip(fresh, range(old, old + len(fresh)), strict=True))
        units = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        once = np.bincount(units, minlength=old + len(fresh))[old:] == 1
        order = np.argsort(once, kind="stable")
        number = np.arange(old + len(fresh))
        number[old + order] = np.arange(old, old + len(fresh))
        fresh = [fresh[i] for i in order.tolist()]
        kept = len(fresh) - int(once.sum())
        self.known.update(zip(fresh[:kept], range(old, old + kept), strict=True))
        for u in fresh[kept:]:
            del self.known[u]
        drawer = self.write(Drawer.build(Lattice.build(fresh, self.vocabulary, self.finder), self.theta), old)
        self.nodes = int(drawer.last[old + kept - 1]) + 1 if old + kept else 0
        self.edges = int(drawer.begin[self.nodes])
        return drawer, number[units]


_tables: dict[tuple, tuple[Backwards, Codec]] = {}


def _units(vocabulary: Vocabulary, theta: float) -> Units:
    """The store of a task. The tables of the latest vocabulary, whose size is fixed, are shared by the tasks of a worker; units known are not."""
    sign = (tuple(vocabulary.pieces), vocabulary.scores.tobytes(), vocabulary.ids.tobytes(), vocabulary.byte_ids.tobytes())
    if sign not in _tables:
        _tables.clear()
        _tables[sign] = (Backwards(vocabulary), Codec(vocabulary))
    return Units(vocabulary, theta, *_tables[sign])


OUT = "sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_sha256 string, decoded boolean"


def _sampler(vocabulary: Vocabulary, key: str, k: int, theta: float, seed: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _units(vocabulary, theta)
        for batch in batches:
            sizes = np.diff(buffers(batch["text"])[0])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), BLOCK_BYTES, "right")))
                yield block(seen, batch[key].slice(lo, hi - lo), [t or "" for t in batch["text"].slice(lo, hi - lo).to_pylist()])
                lo = hi

    def block(seen: Units, names: pa.Array, texts: list[str]) -> pa.RecordBatch:
        keys = np.array([int.from_bytes(hashlib.blake2b(f"{seed}|{v}".encode(), digest_size=8).digest(), "little") for v in names.to_pylist()], np.uint64)
        marked = [META + t.replace(" ", META) if t else "" for t in texts]
        split = [UNIT.findall(t) for t in marked]
        upto = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int64)
        drawer, units = seen.of(list(itertools.chain.from_iterable(split)))
        del split
        found, kappa = search(drawer, units, upto, keys, k)
        whole = [t.encode("utf-8", "surrogatepass") for t in marked]
        parts = []
        for i, s in enumerate(found):
            ids, bounds = seen.codec.ids(drawer, s)
            raw, ends = seen.codec.bytes_of(ids, bounds)
            raw, b, e = raw.tobytes(), bounds.tolist(), ends.tolist()
            low = s.log - kappa[s.texts]
            inclusion = np.where(kappa[s.texts] == -np.inf, 1.0, -np.expm1(-np.exp(np.minimum(low, 700.0))))
            columns = {
                key: names.take(pa.array(s.texts)),
                "sample": pa.array(np.full(len(s.texts), i + 1), pa.int32()),
                "n_pieces": pa.array(np.diff(bounds), pa.int64()),
                "log_prob": pa.array(s.log),
                "perturbed": pa.array(s.value),
                "inclusion": pa.array(inclusion),
                "ids_sha256": pa.array([hashlib.sha256(ids[x:y]).hexdigest() for x, y in itertools.pairwise(b)], pa.string()),
                "decoded": pa.array([raw[x:y] == whole[t] for (x, y), t in zip(itertools.pairwise(e), s.texts.tolist(), strict=True)], pa.bool_()),
            }
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            parts.append(pa.table(columns))
        return pa.concat_tables(parts).combine_chunks().to_batches()[0] if texts else None

    return run


def sample_pieces(
    docs: DataFrame, k: int = 2, theta: float = 1.0, seed: int = 0, key: str = "doc_id", with_ids: bool = False, model_path: str = DEFAULT_MODEL
) -> DataFrame:
    """key, sample (1 to k), n_pieces, log_prob, perturbed, inclusion, ids_sha256, decoded and, if asked for, ids of every row.

    decoded says that decoding the ids gives the text back.
    """
    vocabulary = Vocabulary.load(model_path)
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {OUT}" + (", ids array<int>" if with_ids else "")
    return plain(docs, key, "text").mapInArrow(frugal(_sampler(vocabulary, key, k, theta, seed, with_ids)), schema)
