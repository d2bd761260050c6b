"""A run-length index of repetitive byte strings: where does a string of a given length occur again?

The suffixes of the joined strings are sorted once by prefix doubling; of that order only the runs of the Burrows-Wheeler transform
are kept, with the text positions at both ends of every run and the match lengths there. Inside a run a match with
the neighbour just gets one shorter from one text position to the next, so matching statistics of all positions
follow from the run ends in one pass along the text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEPARATOR = 0xFF  # never part of UTF-8


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``text`` and its big-endian 8-byte words at every position (zeros past the end)."""
    n = len(text)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = text
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words |= padded[k : k + n] << np.uint64(56 - 8 * k)
    order = np.argsort(words).astype(np.int32)
    key = words[order]
    opens = np.ones(n + 1, bool)
    opens[1:n] = key[1:] != key[:-1]
    del padded, key
    rank = np.zeros(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(opens[:n], np.arange(n, dtype=np.int32), 0))
    depth = 8
    while True:
        tied = np.nonzero(~(opens[:-1] & opens[1:]))[0]
        if not len(tied):
            return order, words
        part = order[tied]
        behind = part + depth
        follow = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        key = (rank[part].astype(np.int64) << 32) | follow
        turn = np.argsort(key)
        part, key = part[turn], key[turn]
        order[tied] = part
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        opens[tied[fresh]] = True
        rank[part] = np.maximum.accumulate(np.where(fresh, tied, 0))
        depth *= 2


def common_prefix(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i and at j, from the 8-byte words of the text."""
    n = len(words)
    out = np.zeros(len(i), np.int64)
    open_ = np.arange(len(i))
    while len(open_):
        a, b = i[open_] + out[open_], j[open_] + out[open_]
        inside = np.maximum(a, b) < n
        diff = np.where(inside, words[np.minimum(a, n - 1)] ^ words[np.minimum(b, n - 1)], np.uint64(1 << 63))
        equal = diff == 0
        rest = diff[~equal]
        # leading equal bytes of the word that differs
        lead = sum((rest < np.uint64(1 << (64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        out[open_[~equal]] += lead
        out[open_[equal]] += 8
        open_ = open_[equal]
    return np.minimum(out, n - np.maximum(i, j))


@dataclass
class RunIndex:
    """Runs of the Burrows-Wheeler transform of the joined strings, sampled at their ends."""

    length: int
    symbols: np.ndarray  # one per run
    heads: np.ndarray  # text position at the first row of every run
    head_match: np.ndarray  # match length there with the row before
    tails: np.ndarray  # text position at the last row of every run
    tail_match: np.ndarray  # match length there with the row after

    @classmethod
    def build(cls, text: np.ndarray) -> RunIndex:
        order, words = suffix_order(text)
        n = len(text)
        symbols = np.where(order > 0, text[order - 1].astype(np.int16), np.int16(-1))
        change = np.nonzero(symbols[1:] != symbols[:-1])[0] + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change - 1, [n - 1]])
        head_match = np.zeros(len(first), np.int64)
        tail_match = np.zeros(len(first), np.int64)
        match = common_prefix(words, order[change - 1], order[change])  # a run's tail is next to the following head
        head_match[1:], tail_match[:-1] = match, match
        return cls(n, symbols[first], order[first], head_match, order[last], tail_match)

    def matching_ends(self) -> np.ndarray:
        """For every text position j the end of the longest string at j that also starts elsewhere."""
        ends = np.zeros(self.length, np.int64)
        np.maximum.at(ends, self.heads, self.heads + self.head_match)
        np.maximum.at(ends, self.tails, self.tails + self.tail_match)
        return np.maximum.accumulate(ends)


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For every string the positions at which ``length`` bytes start that also start at another position of any string."""
    if not strings:
        return []
    sizes = np.array([len(s) for s in strings])
    stops = np.cumsum(sizes + 1)
    text = np.frombuffer(bytes([SEPARATOR]).join(strings) + bytes([SEPARATOR]), np.uint8)
    ends = RunIndex.build(text).matching_ends()
    out = []
    for size, stop in zip(sizes.tolist(), stops.tolist(), strict=True):
        lo = stop - 1 - size
        own = np.minimum(ends[lo : stop - 1], stop - 1) - np.arange(lo, stop - 1)
        out.append(np.nonzero(own >= length)[0])
    return out
