"""Motif discovery by greedy, random and Gibbs search.

Each start of a search is a row; searches run side by side in Arrow batches over
the list of sequences, which is broadcast (it is bounded by MAX_SYMBOLS).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_SYMBOLS = 50_000_000
_CODE = {b: i for i, pair in enumerate(("Aa", "Cc", "Tt", "Gg")) for b in pair}


def _sequences(seqs: DataFrame) -> list[str]:
    size = seqs.agg(F.sum(F.length("seq"))).first()[0] or 0
    if size > MAX_SYMBOLS:
        raise ValueError(f"{size} symbols are more than {MAX_SYMBOLS}; search a part or split the table")
    return [r["seq"] for r in seqs.orderBy("id").collect()]


def _codes(text: str) -> np.ndarray:
    return np.array([_CODE[b] for b in text], np.int64)


def _windows(code: np.ndarray, k: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(code, k)


def _profile(chosen: np.ndarray) -> np.ndarray:
    """Counts plus one: products of whole numbers rank windows exactly as shares do."""
    return np.stack([(chosen == b).sum(0) + 1 for b in range(4)], 1)


def _most_probable(code: np.ndarray, k: int, profile: np.ndarray) -> int:
    w = _windows(code, k)
    score = np.ones(len(w), object if k > 12 else np.int64)
    for j in range(k):
        score = score * profile[j][w[:, j]]
    return int(np.argmax(score))


def _hamming(chosen: np.ndarray) -> int:
    return int(sum(len(chosen) - max((chosen[:, j] == b).sum() for b in range(4)) for j in range(chosen.shape[1])))


def _pick(codes: list[np.ndarray], at: list[int], k: int) -> np.ndarray:
    return np.stack([c[i : i + k] for c, i in zip(codes, at, strict=True)])


def _search(seqs: DataFrame, k: int, starts: DataFrame, one) -> DataFrame:
    """kmers, hamming of each start (column ``start``); ``one(codes, start, k)`` gives the windows' places."""
    texts = _sequences(seqs)
    shipped = seqs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = shipped.value
        codes = [_codes(t) for t in texts]
        for b in batches:
            rows = []
            for start in b["start"]:
                if not codes or min(map(len, codes)) < k:
                    continue
                at = one(codes, int(start), k)
                rows.append((int(start), [t[i : i + k] for t, i in zip(texts, at, strict=True)], _hamming(_pick(codes, at, k))))
            yield pd.DataFrame(rows, columns=["start", "kmers", "hamming"])

    return starts.mapInPandas(run, "start long, kmers array<string>, hamming long")


def _best(found: DataFrame) -> DataFrame:
    best = found.agg(F.min("hamming").alias("best"))
    return found.join(F.broadcast(best), F.col("hamming") == F.col("best")).drop("best")


def greedy_motifs(seqs: DataFrame, k: int) -> DataFrame:
    """start, kmers, hamming: the best sets over all windows of the first sequence."""
    n = seqs.agg(F.min_by("seq", "id").alias("s")).select((F.length("s") - k + 1).alias("n"))
    starts = n.select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))).alias("start"))

    def one(codes, start, k):
        at = [start]
        for c in codes[1:]:
            at.append(_most_probable(c, k, _profile(_pick(codes[: len(at)], at, k))))
        return at

    return _best(_search(seqs, k, starts, one))


def _converged(codes, at, k):
    score = _hamming(_pick(codes, at, k))
    while True:
        profile = _profile(_pick(codes, at, k))
        at = [_most_probable(c, k, profile) for c in codes]
        new = _hamming(_pick(codes, at, k))
        if new == score:
            return at
        score = new


def _random_at(codes, k, rng):
    return [int(rng.integers(len(c) - k + 1)) for c in codes]


def draw(seed: int, key) -> Column:
    """A whole number below 2**28 for each key, alike for equal seeds: the first seven digits of an MD5 digest."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")


def random_kmers(seqs: DataFrame, k: int, seed: int) -> DataFrame:
    """id, kmer: one window of each sequence, alike for equal seeds; null when it is shorter."""
    n = F.length("seq") - k + 1
    at = F.pmod(draw(seed, "id"), F.when(n > 0, n)).cast("int")
    return seqs.select("id", F.substring(F.col("seq"), at + 1, F.lit(k)).alias("kmer"))


def converged_motifs(seqs: DataFrame, k: int, starts: int, seed: int) -> DataFrame:
    """start, kmers, hamming of every random start."""
    def one(codes, start, k):
        return _converged(codes, _random_at(codes, k, np.random.default_rng([seed, start])), k)

    return _search(seqs, k, seqs.sparkSession.range(starts).withColumnRenamed("id", "start"), one)


def random_motif_search(seqs: DataFrame, k: int, starts: int, seed: int) -> DataFrame:
    """kmers, hamming: the distinct best sets of all random starts."""
    return _best(converged_motifs(seqs, k, starts, seed)).select("kmers", "hamming").distinct()


def gibbs_sampler(codes, start, k, steps, seed):
    rng = np.random.default_rng([seed, start, 1])
    at = _random_at(codes, k, rng)
    best, score = list(at), _hamming(_pick(codes, at, k))
    for _ in range(steps):
        i = int(rng.integers(len(codes)))
        others = [j for j in range(len(codes)) if j != i]
        profile = _profile(_pick([codes[j] for j in others], [at[j] for j in others], k)) if others else np.ones((k, 4), np.int64)
        w = _windows(codes[i], k)
        p = np.ones(len(w))
        for j in range(k):
            p = p * profile[j][w[:, j]]
        at[i] = rand_weighted(p, rng)
        new = _hamming(_pick(codes, at, k))
        if new < score:
            best, score = list(at), new
    return best


def rand_weighted(weights: np.ndarray, rng) -> int:
    """An index with a chance in proportion to its weight."""
    run = np.cumsum(weights)
    return min(int(np.searchsorted(run, rng.random() * run[-1], side="right")), len(run) - 1)


def gibbs_motif_search(seqs: DataFrame, k: int, steps: int, starts: int, seed: int) -> DataFrame:
    """kmers, hamming: the distinct best sets of all starts."""
    found = _search(
        seqs, k, seqs.sparkSession.range(starts).withColumnRenamed("id", "start"), lambda c, s, k: gibbs_sampler(c, s, k, steps, seed)
    )
    return _best(found).select("kmers", "hamming").distinct()


def weighted_choice(rows: DataFrame, seed: int) -> DataFrame:
    """For each id one row (id, item, weight) with a chance in proportion to its weight, by a seeded draw."""
    w = W.partitionBy("id").orderBy("item")
    run = F.sum("weight").over(w.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("weight").over(W.partitionBy("id"))
    share = draw(seed, "id") / float(1 << 28)
    return rows.withColumn("run", run).withColumn("total", total).where(F.col("run") > share * F.col("total")).groupBy("id").agg(
        F.min_by("item", "run").alias("item")
    )
