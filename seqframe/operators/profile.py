"""Positional counts of sequences, consensus and entropies.  Ties go to the first of A, C, T, G."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seq as S
from .kmers import kmers, symbols

B = ["a", "c", "t", "g"]


def count_profile(seqs: DataFrame) -> DataFrame:
    """pos, a, c, t, g: counts of either case; other symbols do not count."""
    each = symbols(seqs).withColumn("sym", S.to_lower("sym"))
    return each.groupBy("pos").agg(*[F.count_if(F.col("sym") == b).alias(b) for b in B])


def frac_profile(seqs: DataFrame, pseudo: int = 0) -> DataFrame:
    """pos, a, c, t, g: shares of the sequences; ``pseudo`` is added to each count."""
    n = seqs.agg(F.count("*").alias("n"))
    p = count_profile(seqs).join(F.broadcast(n))
    return p.select("pos", *[((F.col(b) + pseudo) / (F.col("n") + 4 * pseudo)).alias(b) for b in B])


def best(values: list[Column] | None = None) -> Column:
    return F.greatest(*(values or [F.col(b) for b in B]))


def modal_base(gap: bool = False) -> Column:
    """Base of the highest count; with ``gap`` a dash where all are 0."""
    out = F.lit("G")
    for b in "TCA":
        out = F.when(F.col(b.lower()) == best(), b).otherwise(out)
    return F.when(best() == 0, "-").otherwise(out) if gap else out


def consensus(profile: DataFrame, gap: bool = True) -> DataFrame:
    """consensus, conservation (sum of the highest counts) of a count profile."""
    each = F.array_sort(F.collect_list(F.struct("pos", modal_base(gap).alias("b"))))
    return profile.agg(
        F.array_join(F.transform(each, lambda x: x["b"]), "").alias("consensus"),
        F.coalesce(F.sum(best()), F.lit(0)).cast("long").alias("conservation"),
    )


def dna_consensus(seqs: DataFrame) -> DataFrame:
    """Consensus over the length of the first sequence (the smallest id)."""
    n = seqs.agg(F.length(F.min_by("seq", "id")).alias("n"))
    inside = count_profile(seqs).join(F.broadcast(n), F.col("pos") < F.col("n")).drop("n")
    return consensus(inside)


def consensus_hamming(seqs: DataFrame) -> DataFrame:
    """Sum over all places of the sequences that differ from the consensus."""
    n = seqs.agg(F.count("*").alias("n"))
    return count_profile(seqs).join(F.broadcast(n)).agg(F.sum(F.col("n") - best()).cast("long").alias("hamming"))


def _term(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(F.when(p > 0, p))).otherwise(0.0)


def entropy_contributions(frac: DataFrame) -> DataFrame:
    return frac.select("pos", *[_term(F.col(b)).alias(b) for b in B])


def entropy(frac: DataFrame) -> DataFrame:
    return frac.agg(F.sum(sum((_term(F.col(b)) for b in B), F.lit(0.0))).alias("entropy"))


def base_shares(seqs: DataFrame) -> DataFrame:
    """a, c, t, g: shares of the bases over all sequences."""
    n = {b: F.sum(x) for b, x in S.base_counts("seq").items()}
    total = sum(n.values(), F.lit(0))
    return seqs.agg(*[S.ieee_div(n[b], total).alias(b) for b in B])


def cross_entropy(frac: DataFrame, background: DataFrame) -> DataFrame:
    """-sum p log2 q with the background shares q of one row; infinite where q is 0 and p is not."""
    q = background.select(*[F.col(b).alias("q" + b) for b in B])
    term = lambda p, x: F.when(p == 0, 0.0).when(x > 0, -p * F.log2(F.when(x > 0, x))).otherwise(F.lit(float("inf")))
    return frac.join(F.broadcast(q)).agg(F.sum(sum((term(F.col(b), F.col("q" + b)) for b in B), F.lit(0.0))).alias("cross_entropy"))


def relative_entropy(frac: DataFrame, background: DataFrame) -> DataFrame:
    q = background.select(*[F.col(b).alias("q" + b) for b in B])
    term = lambda p, x: F.when(p == 0, 0.0).when(x > 0, p * F.log2(F.when((x > 0) & (p > 0), p / x))).otherwise(F.lit(float("inf")))
    return frac.join(F.broadcast(q)).agg(F.sum(sum((term(F.col(b), F.col("q" + b)) for b in B), F.lit(0.0))).alias("relative_entropy"))


def probabilities(windows: DataFrame, frac: DataFrame) -> DataFrame:
    """Adds ``prob`` to rows (id, pos, kmer): the product of the profile's columns, in their order."""
    table = frac.agg(F.array_sort(F.collect_list(F.struct("pos", *B))).alias("p"))
    k = S.to_lower("kmer")

    def one(row: Column, i: Column) -> Column:
        x = F.substring(k, i + 1, F.lit(1))
        out = row["g"]
        for b in "tca":
            out = F.when(x == b, row[b]).otherwise(out)
        return out

    return windows.join(F.broadcast(table)).withColumn(
        "prob", F.aggregate(F.transform("p", one), F.lit(1.0), lambda a, x: a * x)
    ).drop("p")


def most_probable(seqs: DataFrame, frac: DataFrame, k: int) -> DataFrame:
    """id, kmer: the first window of the highest probability in each sequence, found before anything is shuffled."""
    table = frac.agg(F.array_sort(F.collect_list(F.struct("pos", *B))).alias("p"))

    def windows(text: S.Text, low: S.Text) -> Column:
        def prob(at: Column) -> Column:
            def one(row: Column, i: Column) -> Column:
                out = row["g"]
                for b in "tca":
                    out = F.when(low.at(at + i) == b, row[b]).otherwise(out)
                return out

            return F.aggregate(F.transform("p", one), F.lit(1.0), lambda a, x: a * x)

        return F.array_max(F.transform(text.starts(k), lambda i: F.struct(prob(i).alias("prob"), (-i).alias("at"), text.sub(i, k).alias("kmer"))))

    best = seqs.join(F.broadcast(table)).select("id", S.read(windows, "seq", S.to_lower("seq")).alias("x")).where("x is not null")
    # rows of one id count together
    return best.groupBy("id").agg(F.max_by("x.kmer", F.struct("x.prob", "x.at")).alias("kmer"))
