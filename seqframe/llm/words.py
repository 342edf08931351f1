"""Hashes of all words of a text at once, without a look at each word.

A word's hash is a polynomial over fixed random numbers of its bytes, modulo 2**64.  Powers
are taken at the bytes' places in the text and the first one divided out (the base
is odd, so it has an inverse), which makes the sum over a word independent of where it stands.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that separate words: ASCII white space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUES = np.random.default_rng(20_240_229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_VALUES[_SPACE] = 0
_SLICE = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash for each run of bytes other than ASCII white space, in order."""
    if len(raw) > _SLICE:
        out, at = [], 0
        while at < len(raw):
            # a slice ends at white space, however far that is
            end = at + _SLICE
            while end < len(raw) and not _SPACE[raw[end]]:
                end += 1
            out.append(_hashes(raw[at:end]))
            at = end
        return np.concatenate(out)
    return _hashes(raw)


def _hashes(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    word = ~_SPACE[a]
    starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    if len(a) and word[0]:
        starts = np.concatenate([[0], starts])
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _tables(len(a))
    h = np.add.reduceat(_VALUES[a] * up[: len(a)], starts) * down[starts]
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))
