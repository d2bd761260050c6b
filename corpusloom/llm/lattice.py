"""Segmentation lattices of many text units at once over a unigram view of a public piece vocabulary.

The vocabulary's pieces get the log probability of their rank by Zipf's law, -ln(rank); nothing is trained. Blanks are written as
the meta symbol, one is put in front of the text, and an unknown character falls back to its bytes.
No piece goes on from a letter to a meta symbol and none holds a line break, so a text falls into units that are segmented
independently: a run of meta symbols with what follows up to the next one, or a line break.

Aho-Corasick, or a trie of the reversed pieces walked at all places in step, finds all pieces in the distinct units of a batch; the dynamic
programmes then run over all units in step, by position.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import sentencepiece

META = "▁"
UNKNOWN_PENALTY = 10.0
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIT = re.compile(f"{META}*[^{META}\n]+|{META}+|\n")


@dataclass
class Vocabulary:
    """Pieces with ids and scores, and the ids of the 256 bytes."""

    pieces: list[str]
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float = field(init=False)
    lengths: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.lengths = np.array([len(p) for p in self.pieces], np.int32)
        self.unknown = float(self.scores.min()) - UNKNOWN_PENALTY

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL) -> Vocabulary:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = -np.log(np.arange(1, len(plain) + 1))
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        return cls([sp.id_to_piece(i) for i in plain], np.array(plain), scores, byte_ids)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if any(c in p for c in "\n") or META in p.lstrip(META):
                raise ValueError(f"piece {p!r} would join two units")
            a.add_word(p, i)
        a.make_automaton()
        return a


class Backwards:
    """All pieces that end at each place of a string, found for all places in step: a trie of the reversed pieces, one level per character.

    The trie is a table of states by character class; a class is a character of some piece of two characters or more, and class 0 is any other.
    """

    def __init__(self, vocabulary: Vocabulary):
        alphabet = sorted({c for p in vocabulary.pieces if len(p) > 1 for c in p})
        alone = sorted({p for p in vocabulary.pieces if len(p) == 1} - set(alphabet))
        number = {c: i + 1 for i, c in enumerate([*alphabet, *alone])}
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in number]] = list(number.values())
        states: dict[tuple[int, int], int] = {}
        final: list[int] = [-1]
        self.one = np.full(len(number) + 1, -1, np.int32)
        for i, p in enumerate(vocabulary.pieces):
            if "\n" in p or META in p.lstrip(META):
                raise ValueError(f"piece {p!r} would join two units")
            if len(p) == 1:
                self.one[number[p]] = i
                continue
            state = 0
            for c in reversed(p):
                state = states.setdefault((state, number[c]), len(final))
                if state == len(final):
                    final.append(-1)
            final[state] = i
        self.final = np.array(final, np.int32)
        self.width = len(alphabet) + 1
        self.next = np.zeros((len(final), self.width), np.int32)  # 0: none
        for (state, c), to in states.items():
            self.next[state, c] = to
        self.next = self.next.ravel()

    def matches(self, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every length from 1 the ends of the pieces found, ascending, and the pieces."""
        classes = self.classes[points]
        one = self.one[classes]
        hit = np.nonzero(one >= 0)[0]
        out = [(hit + 1, one[hit])]
        classes[classes >= self.width] = 0
        end = np.nonzero(classes)[0]
        state = self.next[classes[end]]
        end, state, size = end[state > 0] + 1, state[state > 0], 1
        while len(end):
            size += 1
            if end[0] < size:
                inside = end >= size
                end, state = end[inside], state[inside]
            state = self.next[state * np.int32(self.width) + classes[end - size]]
            alive = np.nonzero(state)[0]
            end, state = end[alive], state[alive]
            piece = self.final[state]
            hit = np.nonzero(piece >= 0)[0]
            out.append((end[hit], piece[hit]))
        return out


def split_units(text: str) -> list[str]:
    """The units of a text; the empty text has none."""
    return UNIT.findall(META + text.replace(" ", META)) if text else []


def byte_widths(points: np.ndarray) -> np.ndarray:
    """Bytes of these code points in UTF-8."""
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)


@dataclass
class Lattice:
    """Edges of the units, ordered by their end and, of one end, by start: node numbers of both ends, piece and score.

    Nodes are numbered unit by unit: ``first[u]`` is the start of unit u, ``last[u]`` its end. piece is -1 - (code point) for an unknown character.
    ``turn`` orders the edges by the position of their end within the unit; ``steps`` are the bounds of each position in it.
    """

    first: np.ndarray
    last: np.ndarray
    tail: np.ndarray
    head: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    turn: np.ndarray
    steps: list[tuple[int, int]]

    @classmethod
    def build(cls, units: list[str], vocabulary: Vocabulary, finder: ahocorasick.Automaton | Backwards) -> Lattice:
        sizes = np.array([len(u) for u in units], np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        last = first + sizes
        joined = "".join([u + "\n" for u in units])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        if isinstance(finder, Backwards):
            found = finder.matches(points)
            fan = np.zeros(len(points) + 1, np.int32)
            for end, _ in found:
                fan[end] += 1
            into = np.cumsum(fan) - fan
            head = np.repeat(np.arange(len(fan), dtype=np.int32), fan)
            piece = np.empty(len(head), np.int32)
            for end, matched in reversed(found):
                piece[into[end]] = matched
                into[end] += 1
        else:  # the automaton goes from end to end and gives the longest piece of an end first
            flat = np.fromiter(itertools.chain.from_iterable(finder.iter(joined)), np.int64).reshape(-1, 2)
            head, piece = (flat[:, 0] + 1).astype(np.int32), flat[:, 1].astype(np.int32)
        tail = head - vocabulary.lengths[piece]
        score = vocabulary.scores[piece]
        lone = np.ones(len(joined), bool)  # characters that are no piece themselves
        lone[found[0][0] - 1 if isinstance(finder, Backwards) else tail[head - tail == 1]] = False
        lone[last] = False  # separators
        single = np.nonzero(lone)[0].astype(np.int32)
        if len(single):
            at = np.searchsorted(head, single + 1, "right")
            piece, score = np.insert(piece, at, -1 - points[single]), np.insert(score, at, vocabulary.unknown)
            tail, head = np.insert(tail, at, single), np.insert(head, at, single + 1)
        depth = head - np.repeat(first.astype(np.int32), sizes + 1)[tail]
        deepest = int(depth.max(initial=0))
        turn = np.argsort(depth.astype(np.uint16) if deepest < 1 << 16 else depth, kind="stable").astype(np.int32)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(depth, minlength=1))])[1:].tolist()
        return cls(first, last, tail, head, piece, score, turn, list(itertools.pairwise(cuts)))

    def nodes(self) -> int:
        return int(self.last[-1]) + 1 if len(self.last) else 0

    def viterbi(self) -> tuple[np.ndarray, np.ndarray]:
        """Best score and piece count of every unit. Of equal scores the longest last piece wins, as in the public encoders."""
        best, count = np.zeros(self.nodes()), np.zeros(self.nodes(), np.int64)
        weight = np.where(self.piece < 0, byte_widths(-1 - self.piece), 1)
        for lo, hi in self.steps:
            if lo == hi:
                continue
            edges = self.turn[lo:hi]
            head, tail = self.head[edges], self.tail[edges]
            value = best[tail] + self.score[edges]
            at = np.nonzero(np.concatenate([[True], head[1:] != head[:-1]]))[0]
            top = np.maximum.reduceat(value, at)
            runs = np.diff(np.append(at, hi - lo))
            hit = np.where(value == np.repeat(top, runs), np.arange(hi - lo), hi - lo)
            choice = np.minimum.reduceat(hit, at)  # edges are in order of their start
            best[head[at]] = top
            count[head[at]] = count[tail[choice]] + weight[edges[choice]]
        return best[self.last], count[self.last]

    def forward(self, theta: float) -> np.ndarray:
        """Log of the summed probability of all ways from the unit's start to every node, at inverse temperature theta."""
        out = np.zeros(self.nodes())
        for lo, hi in self.steps:
            if lo == hi:
                continue
            edges = self.turn[lo:hi]
            head = self.head[edges]
            value = out[self.tail[edges]] + theta * self.score[edges]
            at = np.nonzero(np.concatenate([[True], head[1:] != head[:-1]]))[0]
            top = np.maximum.reduceat(value, at)
            out[head[at]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, np.diff(np.append(at, hi - lo)))), at))
        return out
