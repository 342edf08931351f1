"""Reconstruction of points from all their pairwise distances."""

from __future__ import annotations

from collections import Counter


def point_sets(distances: dict[int, int]) -> list[list[int]]:
    """All placements, each from 0 and the greatest distance on; the given multiset is not changed.

    The greatest distance left must reach from one end; the far point is tried first.
    """
    left = Counter({int(d): int(n) for d, n in distances.items() if n > 0})
    if not left:
        return []
    width = max(left)
    left[width] -= 1
    points, found = [0, width], []

    def place(x: int) -> Counter | None:
        need = Counter(abs(x - p) for p in points)
        return need if all(left[d] >= n for d, n in need.items()) else None

    def search() -> None:
        far = max((d for d, n in left.items() if n > 0), default=None)
        if far is None:
            found.append(list(points))
            return
        for x in dict.fromkeys((width - far, far)):
            if (need := place(x)) is not None:
                left.subtract(need)
                points.append(x)
                search()
                points.pop()
                left.update(need)

    search()
    return found
