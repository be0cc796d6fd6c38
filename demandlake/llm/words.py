"""Hashes of words and word shingles of a batch of texts, in numpy."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWER = np.empty(4096, np.uint64)
_x = 1
for _i in range(4096):
    _POWER[_i] = _x
    _x = _x * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, number of words before each text and in
    all).  Words are what ASCII white space separates."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = _SPACE[data]
    at = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    ends = np.cumsum([len(r) + 1 for r in raw])
    offsets = np.r_[0, np.searchsorted(at, ends)]
    if not len(at):
        return np.zeros(0, np.uint64), offsets
    length = np.diff(np.r_[at, len(data)])
    place = np.arange(len(data)) - np.repeat(np.r_[0, at], np.r_[at[0], length])
    term = np.where(blank, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWER[place & 4095])
    far = place >> 12
    if far.any():
        term = np.where(far > 0, mix(term + far.astype(np.uint64)), term)
    return mix(np.add.reduceat(term, at)), offsets


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of the runs of ``size`` words (all words, if fewer; none: empty)."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    return mix(out)
