"""Words and word shingles of whole texts as 64-bit hashes, vectorised over the bytes of many texts.

Words are the runs of bytes other than space and \\t\\n\\v\\f\\r after lower-casing A-Z. A word's hash
is a polynomial over its bytes, taken from prefix sums, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n - 1 modulo 2 ** 64; grown as needed and kept."""
    if len(_powers.get(base, ())) < n:
        x = np.full(max(n, 1 << 20), base, np.uint64)
        x[0] = 1
        _powers[base] = np.multiply.accumulate(x)
    return _powers[base][:n]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of the texts, in order: text's index, start and end in its bytes, hash."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(sizes + 1)))
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    gap = np.ones(len(data) + 1, bool)
    gap[1:] = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=prefix[1:])
    h = mix((prefix[end] - prefix[start]) * _power(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    of = np.searchsorted(first, start, "right") - 1
    return of, start - first[of], end - first[of], h


_TURN = [int(x) | 1 for x in mix(np.arange(1001, 1033, dtype=np.uint64))]


def shingles(of: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of its first word, hash) of each run of k words that lies within one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(of[:n] == of[k - 1 :])
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total += h[i : i + n] * np.uint64(_TURN[i])
    return at, mix(total[at])


def batched(texts: Iterable[bytes], most: int = 1 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in lists of about `most` bytes and `rows` texts at most, so that a batch's arrays stay small."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and (size + len(t) > most or len(held) >= rows):
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending; a text of fewer than k words has one of them all, one without words none."""
    out: list[np.ndarray] = []
    for _, part in batched(texts):
        of, _, _, h = words(part)
        at, s = shingles(of, h, k)
        lo = np.searchsorted(of[at], np.arange(len(part) + 1))
        wlo = np.searchsorted(of, np.arange(len(part) + 1))
        for i in range(len(part)):
            own = s[lo[i] : lo[i + 1]]
            if len(own):
                own = np.unique(own)
            elif n := wlo[i + 1] - wlo[i]:
                few = h[wlo[i] : wlo[i + 1]]
                own = mix(np.array([sum(int(x) * t for x, t in zip(few, _TURN)) % (1 << 64)], np.uint64) + np.uint64(n))
            out.append(own)
    return out
