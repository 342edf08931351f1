"""Distances of every text of one block to every text of another, in arrays."""

from __future__ import annotations

import numpy as np


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a text a row with 0 after its end, and lengths."""
    joined = "".join(t or "" for t in texts)
    flat = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    if len(flat) and flat.max() < 256:
        flat = flat.astype(np.uint8)
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(texts), width), flat.dtype)
    out[np.arange(width) < lengths[:, None]] = flat
    return out, lengths


def _side_by_side(a: list, b: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    both, lengths = codes(a + b)
    return both[: len(a)], both[len(a) :], lengths


def hamming(a: list, b: list) -> np.ndarray:
    """Places that differ; an error for unequal lengths."""
    x, y, lengths = _side_by_side(a, b)
    if len(np.unique(lengths)) > 1:
        raise ValueError("sequences of unequal length")
    out = np.zeros((len(a), len(b)), np.uint8 if x.shape[1] < 256 else np.int32)
    y = np.ascontiguousarray(y.T)
    for i in range(x.shape[1]):
        out += x[:, i, None] != y[i]
    return out.astype(np.int64)


def titv(a: list, b: list) -> np.ndarray:
    """Transitions over transversions of texts in capitals, as IEEE 754 divides; other symbols do not count."""
    x, y, _ = _side_by_side(a, b)
    bit = np.zeros(256, np.uint8)
    for i, c in enumerate("AGCT"):
        bit[ord(c)] = 1 << i
    x, y = (bit[np.where(v < 256, v, 0).astype(np.uint8)] for v in (x, y))
    kind = np.zeros((2, 16), np.uint8)
    kind[0, [0b0011, 0b1100]] = 1
    kind[1, [0b0101, 0b1001, 0b0110, 0b1010]] = 1
    count = np.uint8 if x.shape[1] < 256 else np.int32
    ti, tv = (np.zeros((len(a), len(b)), count) for _ in range(2))
    y = np.ascontiguousarray(y.T)
    for i in range(x.shape[1]):
        pair = x[:, i, None] | y[i]
        ti += kind[0][pair]
        tv += kind[1][pair]
    with np.errstate(divide="ignore", invalid="ignore"):
        return ti.astype(float) / tv


def _kmers(x: np.ndarray, lengths: np.ndarray, k: int, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and symbols' numbers (one number for a k-mer where 62 bits hold it) of every window."""
    width = max(x.shape[1] - k + 1, 0)
    row, at = np.nonzero(np.arange(width) <= (lengths - k)[:, None])
    number = np.searchsorted(base, x)
    parts = [number[row, at + j] for j in range(k)]
    return row, np.stack(parts, axis=1) if parts else np.zeros((len(row), 0), np.int64)


def composition(k: int):
    """The kernel of summed differences of k-mer counts."""

    def distance(a: list, b: list) -> np.ndarray:
        x, y, lengths = _side_by_side(a, b)
        n, base = len(a), np.unique(np.concatenate([x.ravel(), y.ravel()]))
        row, parts = _kmers(np.concatenate([x, y]), lengths, k, base)
        code = np.zeros(len(row), np.int64)
        bits = max(int(len(base)).bit_length(), 1)
        for j in range(k):
            if bits * (j + 1) > 62 and j:
                # the distinct beginnings get new numbers, so that one more symbol fits
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            code = code * max(len(base), 1) + parts[:, j]
        code = np.unique(code, return_inverse=True)[1].astype(np.int64) if len(code) else code
        key, count = np.unique(code * len(lengths) + row, return_counts=True)
        code, row = np.divmod(key, len(lengths))
        kind = np.uint16 if lengths.max(initial=0) < 1 << 16 else np.int64
        common, count = np.zeros((n, len(b)), kind), count.astype(kind)
        bounds = np.flatnonzero(np.diff(code, prepend=-1, append=-1)) if len(code) else np.zeros(1, np.int64)
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            # rows come in order: those of a, then those of b
            split = low + int(np.searchsorted(row[low:high], n))
            if low < split < high:
                ra, rb, ca, cb = row[low:split], row[split:high] - n, count[low:split], count[split:high]
                if len(ra) * len(rb) * 20 > common.size:
                    whole_a, whole_b = np.zeros(n, kind), np.zeros(len(b), kind)
                    whole_a[ra], whole_b[rb] = ca, cb
                    common += np.minimum(whole_a[:, None], whole_b)
                else:
                    common[np.ix_(ra, rb)] += np.minimum(ca[:, None], cb)
        total = np.maximum(lengths - k + 1, 0)
        return total[:n, None] + total[n:] - 2 * common.astype(np.int64)

    return distance
