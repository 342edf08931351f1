"""Benchmark decontamination by greedy string tiling.

A tile is a run of tokens that a document and a benchmark item share; tiles do not
overlap in either.  Longest runs are taken first, so a passage whose sentences were
reordered is still covered, tile by tile.  A document is contaminated when the tiles
of some item cover at least COVERAGE of the item's tokens.

How: rolling (Karp-Rabin) hashes of MIN_TILE tokens of the items form a seed table; the same
hashes of each whole document are looked up in it.  Seeds on one diagonal that touch
form the maximal runs, which are compared token by token; then the longest unmarked run is marked
again and again, and what a mark cuts off a shorter run goes back into the queue.

Tokens: runs of letters and digits of the lower-cased text, single characters of scripts that
write no spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer); all else separates.

Scale: documents are read once and never shuffled.  Items are shipped to the tasks in
blocks of at most BLOCK_BYTES of text; a larger benchmark adds blocks, not size.

Cases: null and empty texts are clean, coverage 0; an item of fewer than MIN_TILE tokens
matches as one exact run; equal items are both reported; equal lengths go to the earlier
place in the item, then in the document; a null item_id is reported as null, after the others;
an empty benchmark leaves all clean.
"""

from __future__ import annotations

import heapq
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, per_worker, table
from .words import word_hashes

MIN_TILE = 4
COVERAGE = 0.5
BLOCK_BYTES = 8 << 20
RESULT = "coverage double, item_ids array<bigint>"
_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Everything in ASCII but letters and digits separates tokens.
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def tokens(text: str) -> np.ndarray:
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return word_hashes(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED))


def seeds(tok: np.ndarray, n: int = MIN_TILE) -> np.ndarray:
    """Hash of each run of n tokens."""
    if len(tok) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(tok) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _MULT + tok[k : len(tok) - n + 1 + k]
    return out ^ (out >> np.uint64(29))


def runs(p: np.ndarray, t: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Longest common runs (diagonal t - p, first place in the item, place after the last) of seed pairs, without a loop over the pairs."""
    if not len(p):
        return []
    order = np.lexsort((p, t - p))
    p, d = p[order], (t - p)[order]
    new = np.ones(len(p), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] > p[:-1] + least)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    return list(zip(d[first].tolist(), p[first].tolist(), (p[last] + least).tolist(), strict=True))


def tile(item: np.ndarray, doc: np.ndarray, p: np.ndarray, t: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length), longest first, from the places of the seeds in item and doc."""
    # equal hashes of different tokens are no seeds
    same = np.ones(len(p), bool)
    for k in range(least):
        same &= item[p + k] == doc[t + k]
    queue = runs(p[same], t[same], least)
    queue = [(s - e, s, s + d) for d, s, e in queue]
    heapq.heapify(queue)
    in_item, in_doc = np.zeros(len(item), bool), set()
    out = []
    while queue:
        neg, p, t = heapq.heappop(queue)
        free = [k for k in range(-neg) if not in_item[p + k] and t + k not in in_doc]
        if len(free) == -neg:
            in_item[p : p - neg] = True
            in_doc.update(range(t, t - neg))
            out.append((p, t, -neg))
            continue
        at = 0
        while at < len(free):
            end = at
            while end + 1 < len(free) and free[end + 1] == free[end] + 1:
                end += 1
            if end - at + 1 >= least:
                heapq.heappush(queue, (-(end - at + 1), p + free[at], t + free[at]))
            at = end + 1
    return out


def _by_id(i: int | None) -> tuple[bool, int]:
    """Ascending, a null id last."""
    return i is None, i or 0


@dataclass
class Index:
    """Seed table of a block of items."""

    ids: list[int | None]
    items: list[np.ndarray]
    hashes: np.ndarray  # ascending, distinct
    first: np.ndarray  # slice of ``where`` of each hash
    where: np.ndarray  # (item, place) pairs
    filter: np.ndarray
    short: dict[int, dict[int, list[int]]]  # items below MIN_TILE tokens, by length and hash

    @staticmethod
    def build(rows: list[tuple[int, str]]) -> Index:
        items = [tokens(t or "") for _, t in rows]
        each = [seeds(x) for x in items]
        h = np.concatenate(each) if each else np.zeros(0, np.uint64)
        where = np.array([(i, p) for i, s in enumerate(each) for p in range(len(s))], np.int64).reshape(-1, 2)
        short: dict[int, dict[int, list[int]]] = {}
        for i, x in enumerate(items):
            if 0 < len(x) < MIN_TILE:
                short.setdefault(len(x), {}).setdefault(int(seeds(x, len(x))[0]), []).append(i)
        order = np.argsort(h, kind="stable")
        hashes, first = np.unique(h[order], return_index=True)
        low = np.zeros(1 << 20, bool)
        low[(hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True
        return Index([i for i, _ in rows], items, hashes, np.append(first, len(h)), where[order], low, short)

    def match(self, text: str, least: float) -> tuple[float, list[int]]:
        """Best coverage of any item, and the ids of those covered enough."""
        doc = tokens(text)
        h = seeds(doc)
        at = np.flatnonzero(self.filter[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        whole = [i for n, own in self.short.items() for g in set(seeds(doc, n).tolist()) & own.keys() for i in own[g]]
        best, found = (1.0, [self.ids[i] for i in whole]) if whole else (0.0, [])
        if not len(at) or not len(self.hashes):
            return best, sorted(found, key=_by_id)
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        hit = self.hashes[k] == h[at]
        if not hit.any():
            return best, sorted(found, key=_by_id)
        # every place of each seed in the items, by item
        j, t = k[hit], at[hit]
        times = self.first[j + 1] - self.first[j]
        spot = np.repeat(self.first[j] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        own, places, t = self.where[spot, 0], self.where[spot, 1], np.repeat(t, times)
        order = np.argsort(own, kind="stable")
        own, places, t = own[order], places[order], t[order]
        each, starts = np.unique(own, return_index=True)
        for i, lo, hi in zip(each.tolist(), starts.tolist(), [*starts[1:].tolist(), len(own)], strict=True):
            item = self.items[i]
            marked = np.zeros(len(item), bool)
            for p in np.unique(places[lo:hi]).tolist():
                marked[p : p + MIN_TILE] = True
            # all seeds together cover no less than the tiles
            bound = marked.mean()
            if bound < least and bound <= best:
                continue
            cover = sum(n for _, _, n in tile(item, doc, places[lo:hi], t[lo:hi])) / len(item)
            best = max(best, cover)
            if cover >= least:
                found.append(self.ids[i])
        return best, sorted(found, key=_by_id)


_index = per_worker(lambda blob: Index.build(pickle.loads(blob)))


class Matcher:
    """A column of struct(coverage, item_ids) for any text column."""

    def __init__(self, benchmark: DataFrame, least: float = COVERAGE):
        spark = benchmark.sparkSession
        rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        n = max(1, -(-size // BLOCK_BYTES))
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        self.least = least
        self.blocks = [
            spark.sparkContext.broadcast(
                pickle.dumps(sorted(((r[0], r[1]) for r in rows.where(block == k).collect()), key=lambda r: (_by_id(r[0]), r[1])))
            )
            for k in range(n)
        ]

    def column(self, text: Column) -> Column:
        out = None
        for shipped in self.blocks:
            got = self._one(shipped)(text)
            out = got if out is None else F.struct(
                F.greatest(out["coverage"], got["coverage"]).alias("coverage"),
                F.array_sort(F.concat(out["item_ids"], got["item_ids"])).alias("item_ids"),
            )
        return out

    def _one(self, shipped):
        least = self.least

        @F.pandas_udf(RESULT)
        def match(texts: pd.Series) -> pd.DataFrame:
            index = _index(shipped.value)
            return pd.DataFrame([index.match(t or "", least) for t in texts], columns=["coverage", "item_ids"])

        return match


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """Rows of ``docs`` (all columns) that no benchmark item's tiles cover enough."""
    name = own_name(docs, "__tiles")
    got = docs.withColumn(name, Matcher(benchmark, least).column(F.col("text")))
    return got.where(F.size(F.col(name)["item_ids"]) == 0).drop(name)


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    matcher = Matcher(table(spark, sf_dir, "benchmark"))
    got = table(spark, sf_dir, "documents").select("doc_id", matcher.column(F.col("text")).alias("m"))
    return got.select(
        "doc_id",
        (F.size("m.item_ids") > 0).alias("contaminated"),
        "m.coverage",
        F.size("m.item_ids").cast("long").alias("n_items"),
        "m.item_ids",
    )
