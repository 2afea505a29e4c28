"""Words and word shingles as 64-bit hashes, a batch of texts at a time."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SLICE = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_INV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of its text), in order. Words are runs of other than ASCII white space.

    A word's hash is a difference of prefix sums of a polynomial over the bytes, so the
    work is a few passes over the bytes and none over the words in Python.
    """
    whole = b" ".join(texts)
    data = np.frombuffer(whole, np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = 1 << max(20, (n - 1).bit_length() if n > 1 else 0)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_R, size)[:n], out=prefix[1:])
    edge = np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashed = mix64((prefix[ends] - prefix[starts]) * _powers(_INV, size)[starts])
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return hashed, np.searchsorted(offsets, starts, side="right") - 1


def groups(texts: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes; a longer text is a range of its own."""
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > SLICE:
            out.append((first, i))
            first, size = i, 0
        size += len(t) + 1
    return [*out, (first, len(texts))] if texts else []


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes, A-Z lower-cased.

    Fewer than k words make one shingle of all of them; no words make none.
    """
    raw = [t.encode().lower() for t in texts]
    out: list[np.ndarray] = []
    for a, b in groups(raw):
        hashed, at = hash_words(raw[a:b])
        cuts = np.searchsorted(at, np.arange(b - a + 1)).tolist()
        joined = np.full(max(0, len(hashed) - k + 1), k, np.uint64)
        for j in range(k):
            joined = mix64(joined * np.uint64(_R) + hashed[j : j + len(joined)])
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo >= k:
                out.append(np.unique(joined[lo : hi - k + 1]))
            elif hi > lo:
                one = np.full(1, hi - lo, np.uint64)
                for w in hashed[lo:hi]:
                    one = mix64(one * np.uint64(_R) + w)
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
