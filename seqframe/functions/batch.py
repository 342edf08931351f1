"""Suffix arrays, alignment scores and codon reading of many texts at once, in arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..alphabet import CODONS

#: Symbols taken at once; longer texts come alone.
SYMBOLS = 1 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut to some SYMBOLS of the texts in their last column, without null texts: with the joined code points and
    the lengths."""
    for whole in batches:
        whole = whole.filter(whole.column(whole.num_columns - 1).is_valid())
        sizes = pc.binary_length(whole.column(whole.num_columns - 1)).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // SYMBOLS
        cuts = np.flatnonzero(np.diff(part)) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True):
            if low < high:
                b = whole.slice(low, high - low)
                yield b, *joined(b.column(b.num_columns - 1))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and how many each has."""
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if int(lengths.sum()) == int(pc.sum(pc.binary_length(texts)).as_py() or 0):
        flat = pa.concat_arrays([texts]).cast(pa.binary())
        ends = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(flat) else np.zeros(0, np.uint8)
        return data.astype(np.int32), lengths
    text = "".join(texts.to_pylist())
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32), lengths


def backward_search(code: np.ndarray, lengths: np.ndarray, sa: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """For each of the joined texts the rows (first, past the last) of its suffix array whose suffixes begin with the
    pattern, which is read from its end over the transform of the text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    bwt = code[starts[text] + (sa - 1) % lengths[text]]
    place = np.arange(len(code)) - starts[text]
    low, high = np.zeros(len(lengths), np.int64), lengths.astype(np.int64)
    for c in map(ord, reversed(pattern)):
        at = np.flatnonzero(bwt == c)
        own, where = text[at], place[at]
        smaller = np.bincount(text[bwt < c], minlength=len(lengths))
        low, high = (smaller + np.bincount(own[where < bound[own]], minlength=len(lengths)) for bound in (low, high))
    return low, high

def suffix_arrays(code: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Starts (from 0 in each text) of the suffixes of each of the joined texts, in their order; ranks of prefixes double
    in length each round."""
    n = len(code)
    if not n:
        return np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    left = (starts + lengths)[text] - np.arange(n)
    distinct = np.unique(code)
    # one rank for each text and symbol
    rank = text * (len(distinct) + 1) + np.searchsorted(distinct, code) + 1
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        inside = left > step
        after[inside] = rank[np.flatnonzero(inside) + step]
        high = int(rank.max()) + 1
        if high >= 1 << 31:
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
            after[inside] = rank[np.flatnonzero(inside) + step]
            high = int(rank.max()) + 1
        key = rank * high + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        if new[-1] == n - 1:
            # texts come in their order, since a rank begins with the text
            return order - starts[text[order]]
        rank = np.empty(n, np.int64)
        rank[order] = new + 1
        step *= 2


def scores(s: np.ndarray, t: np.ndarray, mode: str, table: np.ndarray, indel: int) -> np.ndarray:
    """Alignment scores of pairs of one length each: rows of symbols' numbers in a square table."""
    (rows, n), m = s.shape, t.shape[1]
    across, down = mode in ("global", "overlap"), mode in ("global", "fitting")
    h = np.zeros((m + 1, rows), np.int64)
    if across:
        h -= indel * np.arange(m + 1)[:, None]
    s, t, best = np.ascontiguousarray(s.T), np.ascontiguousarray(t.T), h.max(axis=0)
    for i in range(n):
        before, h = h, np.empty_like(h)
        h[0] = -indel * (i + 1) if down else 0
        for j in range(m):
            x = np.maximum(before[j] + table[s[i], t[j]], np.maximum(before[j + 1], h[j]) - indel)
            h[j + 1] = np.maximum(x, 0) if mode == "local" else x
        if mode == "local":
            best = np.maximum(best, h.max(axis=0))
    return h[m] if mode == "global" else best if mode == "local" else h.max(axis=0)


_RESIDUES = np.frombuffer(CODONS.encode(), np.uint8)


def peptide_sites(code: np.ndarray, lengths: np.ndarray, peptide: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and strand of every site that reads the peptide in the joined texts (code points)."""
    if not peptide.isascii():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    opposite = np.arange(256, dtype=code.dtype)
    for a, b in zip("ACTGactg", "TGACtgac", strict=True):
        opposite[ord(a)] = ord(b)
    # the letter that stands opposite; others stay
    other = code.copy()
    small = code < 256
    other[small] = opposite[code[small]]
    text = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    size = 3 * len(peptide)
    want = np.frombuffer(peptide.encode(), np.uint8)
    found = []
    for strand, symbols in ((1, code), (-1, other)):
        digit = ((symbols & 6) >> 1).astype(np.uint8)
        places = np.flatnonzero(((starts + lengths)[text] - np.arange(len(code))) >= size)
        for k in range(len(peptide)):
            at = places + (3 * k if strand == 1 else size - 3 * k - 1)
            one, two = (1, 2) if strand == 1 else (-1, -2)
            residue = _RESIDUES[digit[at].astype(np.int64) * 16 + digit[at + one] * 4 + digit[at + two]]
            places = places[residue == want[k]]
        found.append((text[places], places - starts[text[places]], np.full(len(places), strand)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def nearest_distances(row: np.ndarray, kmers: np.ndarray, rows: int, k: int) -> np.ndarray:
    """Least Hamming distance of each of all 4**k k-mers (axes in order) to the k-mers of each row; ``kmers`` holds
    numbers 0 to 3 for bases, 4 for any other symbol.  Rows without k-mers get k."""
    held = np.zeros((rows,) + (5,) * k, bool)
    held[(row, *kmers.T)] = True
    out = np.full((rows,) + (4,) * k, k, np.int64)
    plain = (slice(None),) + (slice(0, 4),) * k
    for d in range(k):
        inside = held[plain]
        out[inside & (out == k)] = d
        # one more place may differ
        wider = held.copy()
        for axis in range(1, k + 1):
            wider |= held.any(axis=axis, keepdims=True)
        held = wider
    return out
