"""Greedy merging of fragments by their longest overlaps."""

from __future__ import annotations


class _Ends:
    """Fragments by the beginnings that an overlap may have: those of at least half their length and shorter ones on demand."""

    def __init__(self):
        self.by_start: dict[str, set[str]] = {}

    def add(self, part: str, sizes: range) -> None:
        for n in sizes:
            self.by_start.setdefault(part[:n], set()).add(part)

    def drop(self, part: str, sizes: range) -> None:
        for n in sizes:
            self.by_start[part[:n]].discard(part)


def _sizes(part: str, least: int) -> range:
    """Overlaps are at least half the shorter fragment, so none is below half the shortest there is."""
    return range((least + 1) // 2, len(part) + 1)


def _best(part: str, ends: _Ends, above: int) -> tuple[int, str] | None:
    """The longest overlap of more than ``above`` symbols of the end of ``part`` with another fragment's start; the first fragment of equal ones."""
    for n in range(len(part), above, -1):
        near = ends.by_start.get(part[-n:])
        fits = [t for t in near or () if t != part and n <= min(len(part), len(t)) and 2 * n >= min(len(part), len(t))]
        if fits:
            return n, min(fits)
    return None


def merged(parts: list[str]) -> str | None:
    """The distinct fragments merged into one, or None if some do not join.

    The longest overlap of all comes first; of equal ones that of the first fragment, then of the first partner.
    """
    if len(parts) == 1:
        return parts[0]
    if not parts or "" in parts:
        return None
    least = min(map(len, parts))
    live, ends = set(parts), _Ends()
    for p in parts:
        ends.add(p, _sizes(p, least))
    found = {p: _best(p, ends, 0) for p in parts}
    while len(live) > 1:
        joins = [(-f[0], p, f[1]) for p, f in found.items() if f]
        if not joins:
            return None
        n, s, t = min(joins)
        whole = s + t[-n:]
        for p in (s, t):
            live.discard(p)
            found.pop(p)
            ends.drop(p, _sizes(p, least))
        if whole not in live:
            live.add(whole)
            ends.add(whole, _sizes(whole, least))
        for p in live:
            # whoever had lost its partner, or may have a longer overlap with the new fragment
            old = found.get(p)
            if p == whole or old is None or old[1] in (s, t):
                found[p] = _best(p, ends, 0)
            else:
                fresh = next((m for m in range(min(len(p), len(whole)), old[0] - 1, -1) if p != whole and 2 * m >= min(len(p), len(whole)) and p.endswith(whole[:m])), 0)
                if fresh > old[0] or (fresh == old[0] and whole < old[1]):
                    found[p] = (fresh, whole)
    return live.pop()
