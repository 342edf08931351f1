"""Suffix arrays and backward search over the Burrows-Wheeler transform of one text."""

from __future__ import annotations

import numpy as np


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def suffix_array(code: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in their order; ranks of prefixes double in length each round."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    rank, step = np.unique(code, return_inverse=True)[1].astype(np.int64), 1
    while True:
        # the rank of what follows, 0 past the end
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        step *= 2


class Occurrences:
    """How often a symbol stands before a place of the transform: the places of each symbol, searched by halves."""

    def __init__(self, symbols: str, firsts, places):
        self.at = {c: (int(f), np.asarray(p)) for c, f, p in zip(symbols, firsts, places, strict=True)}

    @staticmethod
    def of(bwt: str) -> tuple[str, list[int], list[list[int]]]:
        """The symbols in order, how many symbols are smaller than each, and the places of each."""
        code = codes(bwt)
        each, back = np.unique(code, return_inverse=True)
        order = np.argsort(back, kind="stable")
        counts = np.bincount(back, minlength=len(each))
        places = np.split(order, np.cumsum(counts)[:-1]) if len(each) else []
        return "".join(map(chr, each.tolist())), (np.cumsum(counts) - counts).tolist(), [p.tolist() for p in places]

    def range(self, pattern: str, n: int) -> tuple[int, int]:
        """The rows (first, past the last) whose suffixes begin with the pattern, read from its end."""
        low, high = 0, n
        for c in reversed(pattern):
            if c not in self.at:
                return 0, 0
            first, places = self.at[c]
            low, high = first + int(np.searchsorted(places, low)), first + int(np.searchsorted(places, high))
            if low >= high:
                return 0, 0
        return low, high
