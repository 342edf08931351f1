"""Mutation neighbourhoods: all k-mers within a Hamming distance, and searches by them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..alphabet import BASES
from ..functions import batch
from ..functions import seq as S
from .kmers import kmers

#: Places of neighbourhoods held at once.
CELLS = 1 << 22


def _step(s: Column) -> Column:
    """The sequence and all that differ from it in one place, whose case they keep."""

    def at(i: Column) -> Column:
        old = F.substring(s, i, F.lit(1))
        small = old == S.to_lower(old)
        each = [F.when(small, b.lower()).otherwise(b) for b in "ACTG"]
        return F.transform(F.array(*each), lambda b: F.concat(F.substring(s, F.lit(1), i - 1), b, F.substring(s, i + 1, F.length(s))))

    return F.array_union(F.array(s), F.flatten(F.transform(S.starts(s, 1), at)))


def variants(s, d: int) -> Column:
    """Distinct sequences within distance d, the sequence itself first."""
    out = F.array(S.col(s))
    for _ in range(max(0, d)):
        out = F.array_distinct(F.flatten(F.transform(out, _step)))
    return out


def number_of_variants(k: int, d: int) -> int:
    return sum(math.comb(k, h) * 3**h for h in range(min(d, k) + 1))


def number_of_variants_column(k, d: int) -> Column:
    """The same for a column of lengths, as a decimal of 38 digits."""
    k = S.col(k)
    out, choose = F.lit(0).cast("decimal(38,0)"), F.lit(1).cast("decimal(38,0)")
    for h in range(d + 1):
        out = out + F.when(k >= h, choose * 3**h).otherwise(0)
        # comb(k, h + 1) from comb(k, h); the quotient is whole
        choose = (choose * F.greatest(k - h, F.lit(0)) / (h + 1)).cast("decimal(38,0)")
        out, choose = out.cast("decimal(38,0)"), choose
    return out


def unique_variants(seqs: DataFrame, k: int, d: int) -> DataFrame:
    """id, kmer: the distinct neighbours of a sequence's distinct k-mers, in capitals."""
    own = kmers(seqs, k, fold=True).select("id", "kmer").distinct()
    return own.select("id", F.explode(variants("kmer", d)).alias("kmer")).distinct()


def modal_variants(seqs: DataFrame, k: int, d: int, both_strands: bool = False) -> DataFrame:
    """id, kmer, n: the k-mers (present or not) with most occurrences within distance d.

    Equal k-mers are counted before their neighbourhoods are made.
    """
    own = kmers(seqs, k)
    if both_strands:
        own = own.unionByName(own.withColumn("kmer", S.reverse_complement8("kmer")))
    n = own.groupBy("id", "kmer").agg(F.count("*").alias("n"))
    near = n.select("id", F.explode(variants("kmer", d)).alias("kmer"), "n").groupBy("id", "kmer").agg(F.sum("n").alias("n"))
    return near.withColumn("r", F.rank().over(W.partitionBy("id").orderBy(F.desc("n")))).where("r = 1").drop("r")


def planted_motifs(seqs: DataFrame, k: int, d: int) -> DataFrame:
    """kmer: those within distance d of some window of every sequence."""
    n = seqs.agg(F.count("*").alias("all"))
    held = unique_variants(seqs, k, d).groupBy("kmer").agg(F.count("*").alias("n"))
    return held.join(F.broadcast(n), F.col("n") == F.col("all")).select("kmer")


def median_motifs(seqs: DataFrame, k: int) -> DataFrame:
    """kmer, hamming: those of all 4**k whose least distances to the sequences sum lowest.

    Distances are taken to the distinct k-mers of each sequence only.
    """
    # rows of one id count together
    own = seqs.groupBy("id").agg(F.collect_list(S.to_upper("seq")).alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0)
            row = np.repeat(np.arange(len(texts)), pc.list_value_length(texts).to_numpy(zero_copy_only=False))
            code, lengths = batch.joined(texts.flatten())
            text = np.repeat(np.arange(len(lengths)), lengths)
            at = np.flatnonzero((np.cumsum(lengths)[text] - np.arange(len(code))) >= k)
            if not len(at):
                continue
            number = np.full(len(code), 4, np.int64)
            for i, c in enumerate(BASES):
                number[code == ord(c)] = i
            # rows with k-mers, some CELLS at once
            owner, row = np.unique(row[text[at]], return_inverse=True)
            total, step = np.zeros(4**k, np.int64), max(1, CELLS // 5**k)
            for low in range(0, len(owner), step):
                here = (row >= low) & (row < low + step)
                kmer = np.stack([number[at[here] + j] for j in range(k)], axis=1)
                least = batch.nearest_distances(row[here] - low, kmer, min(step, len(owner) - low), k)
                total += least.reshape(-1, 4**k).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(4**k)), pa.array(total)], ["code", "d"])

    sums = own.select("texts").mapInArrow(run, "code long, d long").groupBy("code").agg(F.sum("d").alias("d"))
    short = seqs.select(F.count_if(F.length("seq") < k).alias("short"))
    total = sums.join(F.broadcast(short)).select(S.kmer_of(F.col("code"), k).alias("kmer"), (F.col("d") + F.col("short") * k).cast("long").alias("hamming"))
    best = total.agg(F.min("hamming").alias("best"))
    return total.join(F.broadcast(best), F.col("hamming") == F.col("best")).drop("best")
