"""Minimal acyclic automata over many words at once, with word numbers, and their search with one error.

Words are rows of a matrix of one-byte symbols. The trie of the sorted words is built level by level, and states with the same
words behind them are merged by a hash of what they accept, from the leaves up. Every transition knows how many words come before it
among those of its state, so the sum along a path is the word's number in sorted order (a perfect hash). A search follows
all queries together, position by position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corpusloom.llm.words import mix


@dataclass
class Automaton:
    """Transitions sorted by state and symbol; state 0 is the start."""

    edges: np.ndarray  # state << 8 | symbol
    targets: np.ndarray
    skips: np.ndarray  # words of the state before those behind this transition
    first: np.ndarray  # first transition of every state, and one more
    final: np.ndarray

    @classmethod
    def build(cls, words: np.ndarray, sizes: np.ndarray) -> Automaton:
        """words: sorted, distinct, zero-padded rows of bytes, at least one; sizes: their lengths."""
        n, width = words.shape
        fresh = np.ones((n, width), bool)  # does the prefix up to this symbol begin here?
        np.logical_or.accumulate(words[1:] != words[:-1], axis=1, out=fresh[1:])
        # nodes of every level as rows that begin them; a node's parent is found by its row
        begin = [np.zeros(1, np.int64)] + [np.nonzero(fresh[:, j] & (sizes > j))[0] for j in range(width)]
        while len(begin) > 1 and not len(begin[-1]):
            begin.pop()
        depth = len(begin)
        hashes: list[np.ndarray] = [None] * depth
        counts: list[np.ndarray] = [None] * depth
        parents: list[np.ndarray] = [None] * depth
        for j in range(depth - 1, -1, -1):
            rows = begin[j]
            final = sizes[rows] == j  # the word that ends here sorts first
            value, count = np.where(final, np.uint64(0x5851F42D4C957F2D), np.uint64(0)), final.astype(np.int64)
            if j + 1 < depth:
                kids = begin[j + 1]
                parents[j + 1] = parent = np.searchsorted(rows, kids, "right") - 1
                np.add.at(value, parent, mix(hashes[j + 1] * np.uint64(0x9E3779B97F4A7C15) + words[kids, j].astype(np.uint64)))
                np.add.at(count, parent, counts[j + 1])
            hashes[j], counts[j] = mix(value), count
        flat, size = np.concatenate(hashes), np.concatenate(counts)
        _, one, state = np.unique(flat, return_index=True, return_inverse=True)
        state = state.ravel()
        start = state[0]
        rename = np.arange(len(one))
        rename[[0, start]] = rename[[start, 0]]
        state, upto = rename[state], np.cumsum([0, *map(len, begin)])
        keeper = np.zeros(len(flat), bool)
        keeper[one] = True
        edge, target, weight = [], [], []
        for j in range(1, depth):
            owner = upto[j - 1] + parents[j]
            kept = keeper[owner]
            edge.append((state[owner[kept]] << 8) | words[begin[j][kept], j - 1])
            mine = np.arange(upto[j], upto[j + 1])[kept]
            target.append(state[mine])
            weight.append(size[mine])
        edge, target, weight = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edge, target, weight))
        turn = np.argsort(edge)
        edge, target, weight = edge[turn], target[turn], weight[turn]
        first = np.searchsorted(edge >> 8, np.arange(len(one) + 1))
        final = np.zeros(len(one), bool)
        final[state] = np.concatenate([sizes[begin[j]] == j for j in range(depth)])
        total = np.concatenate([[0], np.cumsum(weight)])
        skips = total[:-1] - total[first[edge >> 8]] + final[edge >> 8] if len(edge) else weight
        return cls(edge, target, skips, first, final)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have a transition by their symbol, and by which."""
        want = (states << 8) | symbols
        place = np.minimum(np.searchsorted(self.edges, want), max(0, len(self.edges) - 1))
        return (self.edges[place] == want) if len(self.edges) else np.zeros(len(want), bool), place

    def one_error(self, words: np.ndarray, sizes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word number): words that a query becomes by replacing or deleting one symbol at a place in [lo, hi).

        The queries' own words are in the automaton. A pair may come more than once.
        """
        n = len(words)
        query, state, number = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)  # without an error so far
        q1, s1, n1 = (np.zeros(0, np.int64) for _ in range(3))  # with one
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for j in range(words.shape[1]):
            ok, place = self.step(s1, words[q1, j])
            q2, s2, n2 = q1[ok], self.targets[place[ok]], n1[ok] + self.skips[place[ok]]
            open_ = (lo[query] <= j) & (j < hi[query])
            q, s, m = query[open_], state[open_], number[open_]
            degree = self.first[s + 1] - self.first[s]
            by = np.repeat(np.arange(len(q)), degree)
            edge = np.arange(len(by)) - np.repeat(np.cumsum(degree) - degree, degree) + self.first[s][by]
            other = (self.edges[edge] & 255) != words[q[by], j]
            by, edge = by[other], edge[other]
            q1 = np.concatenate([q2, q[by], q])
            s1 = np.concatenate([s2, self.targets[edge], s])
            n1 = np.concatenate([n2, m[by] + self.skips[edge], m])
            _, place = self.step(state, words[query, j])
            state, number = self.targets[place], number + self.skips[place]
            over = sizes[q1] == j + 1
            done = over & self.final[s1]
            found.append((q1[done], n1[done]))
            q1, s1, n1 = q1[~over], s1[~over], n1[~over]
            more = sizes[query] > j + 1
            query, state, number = query[more], state[more], number[more]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])
