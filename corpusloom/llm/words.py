"""64-bit hashes of the words of many texts at once, straight from Arrow's string buffers.

A word is a maximal run of bytes other than blank (0x20, 0x09-0x0D); A-Z count as a-z. Its hash is a
polynomial over a random byte table, taken from prefix sums modulo 2**64 and finally mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(_BASE))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = stream(7, 256)[_LOWER]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the base and of its inverse, or more; those of some blocks' length are kept, those of longer texts are not."""
    if len(_POWERS[0]) > n:
        return _POWERS[0], _POWERS[1]
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n + 1, base & _MASK, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, out=steps))
    if n <= 2 * BLOCK_BYTES:
        _POWERS[:] = out
    return out[0], out[1]


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    arr = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    arr = arr.cast(pa.large_string())
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(arr) and arr.buffers()[2] else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(offsets: np.ndarray, data: np.ndarray, blank: np.ndarray = _BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in ``data``, and the number of words before each text (one more at the end); ``blank`` says which bytes are in none."""
    solid = ~blank[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[:-1][np.diff(offsets) > 0]  # words never run on into the next text
    first[cuts] = solid[cuts]
    inner = cuts[cuts > 0]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.nonzero(first)[0], np.nonzero(last)[0] + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(offsets: np.ndarray, data: np.ndarray, spans: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words before each text (one more at the end)."""
    starts, ends, upto = spans if spans is not None else word_spans(offsets, data)
    power, inverse = _powers(max(len(data), BLOCK_BYTES))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), upto


def hashed(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of texts with the hashes of their words and the number of words before each text."""
    offsets, data = buffers(column)
    for lo, hi in blocks(offsets):
        own = offsets[lo : hi + 1]
        h, upto = word_hashes(own - own[0], data[own[0] : own[-1]])
        yield lo, hi, h, upto


_COEFFICIENT = stream(11, 64) | np.uint64(1)


def shingle_sets(column: pa.ChunkedArray | pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    A text with fewer words is one shingle, the whole sequence; one without words has none.
    """
    for lo, hi, h, upto in hashed(column):
        full = np.zeros(0, np.uint64)
        if len(h) >= words:
            full = h[: len(h) - words + 1] * _COEFFICIENT[0]
            for k in range(1, words):
                full = full + h[k : len(h) - words + 1 + k] * _COEFFICIENT[k]
            full = mix(full)
        for d in range(hi - lo):
            a, b = int(upto[d]), int(upto[d + 1])
            if b - a >= words:
                yield np.unique(full[a : b - words + 1])
            elif b > a:
                short = (h[a:b] * _COEFFICIENT[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([short], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
