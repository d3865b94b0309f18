"""Vectorised word and word-window hashing over the bytes of many texts at once.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``; as these are ASCII, the runs are the same on bytes and
on code points. A word's 64-bit hash is a polynomial over a fixed random byte table, so all words of a slice come
from one cumulative pass; windows of words are a second polynomial over the mixed word hashes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240601)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE[_SPACE] = 0
_LOWER = _TABLE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _TABLE[ord("a") : ord("z") + 1]
#: ASCII punctuation also parts words of this kind, and A-Z are hashed as a-z.
_PARTS = _SPACE.copy()
_PARTS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_FOLDED = np.where(_PARTS, np.uint64(0), _LOWER)
KINDS = {"plain": (_TABLE, _SPACE), "lower": (_LOWER, _SPACE), "folded": (_FOLDED, _PARTS)}
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C55  # odd, so that it has an inverse modulo 2**64
_STEP = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


_UP = _powers(_BASE, _BLOCK)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, kind: str = "plain") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the rows' words, byte at which each word starts) over rows of bytes.

    ``kind``: "plain", "lower" (A-Z hashed as a-z) or "folded" (also parted at ASCII punctuation). Long inputs are hashed in blocks; a word across blocks is summed over them.
    """
    total = len(raw)
    if not total:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), np.empty(0, np.int64)
    table, parts = KINDS[kind]
    inside = ~parts[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < total]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    row_words = np.searchsorted(starts, offsets).astype(np.int64)
    hashes = np.zeros(len(starts), dtype=np.uint64)
    for at in range(0, total, _BLOCK):
        part = table[raw[at : at + _BLOCK]] * _UP[: min(_BLOCK, total - at)]
        a, b = np.searchsorted(starts, [at, at + _BLOCK])
        here = starts[a:b] - at
        if a and (not len(here) or here[0]):  # the word that began in an earlier block goes on
            rest = int(part[: here[0] if len(here) else None].sum(dtype=np.uint64))
            back = at - int(starts[a - 1])
            hashes[a - 1] = (int(hashes[a - 1]) + rest * pow(_BASE, back, 1 << 64)) % (1 << 64)
        if len(here):
            hashes[a:b] += np.add.reduceat(part, here) * _DOWN[here]
    return mix(hashes), row_words, starts


def windows(hashes: np.ndarray, row_words: np.ndarray, size: int, salt: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``size`` words from each word on, whether they lie in one row) for every word but the last ones."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    out = np.zeros(n, dtype=np.uint64)
    base = (_STEP * (2 * salt + 1)) % (1 << 64) | 1
    weight = 1
    for k in range(size):
        out += hashes[k : k + n] * np.uint64(weight)
        weight = weight * base % (1 << 64)
    whole = np.ones(len(hashes), dtype=bool)
    for k in range(1, size):  # the last size-1 words of each row begin no window
        last = row_words[1:] - k
        whole[last[last >= row_words[:-1]]] = False
    return mix(out), whole[:n]
