"""Small and large parsimony of one tree, with unit costs."""

from __future__ import annotations

import numpy as np
import pandas as pd

from ..alphabet import BASES


def _fill(children: dict[int, list[int]], order: list[int], root: int, seqs: dict[int, str]) -> dict[int, str]:
    """Sequences of all nodes; ``order`` has children before parents."""
    width = len(next(iter(seqs.values()), ""))
    table: dict[int, np.ndarray] = {}
    for x in order:
        if x in seqs and not children.get(x):
            code = np.array([BASES.index(c) for c in seqs[x].upper()], int)
            table[x] = np.where(np.arange(4)[:, None] == code[None, :], 0, 1 << 30)
        else:
            table[x] = sum((np.minimum(table[y], table[y].min(0) + 1) for y in children[x]), np.zeros((4, width), int))
    chosen = {root: table[root].argmin(0)}
    for x in reversed(order):
        for y in children.get(x, ()):
            t, up = table[y], chosen[x]
            keep = t[up, np.arange(width)] <= t.min(0) + 1
            # the parent's base unless another saves more than the change costs
            chosen[y] = np.where(keep & (t[up, np.arange(width)] <= t.min(0) + (t.argmin(0) != up)), up, t.argmin(0))
    return {x: seqs[x] if x in seqs and not children.get(x) else "".join(BASES[k] for k in c) for x, c in chosen.items()}


def changes(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a.upper(), b.upper(), strict=True))


def _down(children: dict[int, list[int]], root: int) -> list[int]:
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += children.get(x, [])
    return order[::-1]


def rooted(rows: pd.DataFrame) -> pd.DataFrame:
    children: dict[int, list[int]] = {}
    parent = {int(n): None if pd.isna(p) else int(p) for n, p in zip(rows["node"], rows["parent"], strict=True)}
    for n in sorted(parent):
        if parent[n] is not None:
            children.setdefault(parent[n], []).append(n)
    root = next(n for n in sorted(parent) if parent[n] is None)
    seqs = {int(n): s for n, s in zip(rows["node"], rows["seq"], strict=True) if isinstance(s, str) and not children.get(int(n))}
    got = _fill(children, _down(children, root), root, seqs)
    out = [(rows["tree_id"].iloc[0], n, parent[n], got[n], 0 if parent[n] is None else changes(got[n], got[parent[n]])) for n in sorted(got)]
    table = pd.DataFrame(out, columns=["tree_id", "node", "parent", "seq", "cost"])
    return table.astype({"parent": "Int32"})


def _label(edges: list[tuple[int, int]], seqs: dict[int, str]) -> tuple[int, dict[int, str]]:
    """Total and sequences of an unrooted tree; where it is rooted does not change the least total of unit costs."""
    near: dict[int, list[int]] = {}
    for u, v in edges:
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    root = min(x for x in near if x not in seqs) if any(x not in seqs for x in near) else min(near)
    children: dict[int, list[int]] = {}
    seen, todo = {root}, [root]
    while todo:
        x = todo.pop()
        children[x] = sorted(y for y in near[x] if y not in seen)
        seen.update(children[x])
        todo += children[x]
    if root in seqs:  # two leaves alone
        got = {x: seqs[x] for x in near}
    else:
        got = _fill(children, _down(children, root), root, seqs)
    return sum(changes(got[u], got[v]) for u, v in edges), got


def exchanges(edges: list[tuple[int, int]]):
    """Edge lists after each nearest-neighbour interchange around each inner edge."""
    near: dict[int, set[int]] = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    for u, v in edges:
        if len(near[u]) == 3 and len(near[v]) == 3:
            x = min(near[u] - {v})
            for y in sorted(near[v] - {u}):
                swap = {frozenset((u, x)): (v, x), frozenset((v, y)): (u, y)}
                yield [swap.get(frozenset(e), e) for e in edges]


def unrooted(tree_id, arcs: pd.DataFrame, tips: pd.DataFrame, improve: bool) -> pd.DataFrame:
    edges = [(int(u), int(v)) for u, v in zip(arcs["u"], arcs["v"], strict=True)]
    seqs = {int(n): s for n, s in zip(tips["node"], tips["seq"], strict=True)}
    columns = ["tree_id", "u", "v", "seq_u", "seq_v", "cost"]
    if not edges:
        return pd.DataFrame([], columns=columns)
    total, got = _label(edges, seqs)
    while improve:
        best = min(((*_label(e, seqs), e) for e in exchanges(edges)), key=lambda x: x[0], default=None)
        if best is None or best[0] >= total:
            break
        total, got, edges = best
    return pd.DataFrame([(tree_id, u, v, got[u], got[v], changes(got[u], got[v])) for u, v in edges], columns=columns)
