"""k-mers, their counts and repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq as S
from ..functions.pairs import composition as composition_kernel
from .distance import block_matrix


def kmers(seqs: DataFrame, k: int, fold: bool = False) -> DataFrame:
    """id, pos, kmer of every window; ``fold`` reads small letters as capitals."""
    s = S.to_upper("seq") if fold else F.col("seq")
    return seqs.select("id", F.inline(S.windows(s, k)))


def symbols(seqs: DataFrame) -> DataFrame:
    return kmers(seqs, 1).withColumnRenamed("kmer", "sym")


def histogram(seqs: DataFrame) -> DataFrame:
    """id, freq: 256 counts, how often each byte value comes in the UTF-8 text."""
    # two hexadecimal digits a byte
    each = lambda t: F.transform(F.sequence(F.lit(0), F.floor(t.length / 2).cast("int") - 1), lambda i: t.sub(2 * i + 1, 2))
    pairs = S.read(each, F.hex(F.encode("seq", "UTF-8")))
    rows = seqs.where(F.length("seq") > 0).select("id", F.explode(pairs).alias("h")).groupBy("id", "h").agg(F.count("*").alias("n"))
    codes = F.conv("h", 16, 10).cast("int")
    got = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(codes.alias("code"), "n"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0).cast("long")))
    return seqs.select("id").join(got, "id", "left").select("id", dense.alias("freq"))


def composition(seqs: DataFrame, k: int, fold: bool = False) -> DataFrame:
    """id, kmer, n."""
    return kmers(seqs, k, fold).groupBy("id", "kmer").agg(F.count("*").alias("n"))


def all_kmers(spark, k: int) -> DataFrame:
    """code, kmer of all 4**k k-mers."""
    return spark.range(4**k).select(F.col("id").alias("code"), S.kmer_of(F.col("id"), k).alias("kmer"))


def frequency_array(seqs: DataFrame, k: int) -> DataFrame:
    """id, freq: counts of all 4**k k-mers in order of their codes; empty for shorter sequences."""
    n = composition(seqs, k, fold=True).select("id", S.number("kmer").alias("code"), "n")
    got = n.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("m"))
    codes = F.sequence(F.lit(0).cast("long"), F.lit(4**k - 1).cast("long"))
    dense = F.transform(codes, lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0).cast("long")))
    none = F.array().cast("array<bigint>")
    return seqs.select("id").join(got, "id", "left").select("id", F.when(F.col("m").isNotNull(), dense).otherwise(none).alias("freq"))


def modal(seqs: DataFrame, k: int, fold: bool = False) -> DataFrame:
    """id, kmer, n, ord of all most frequent k-mers.

    They come in the order in which each reached its count; with ``fold`` in the order of their codes.
    """
    each = kmers(seqs, k, fold).groupBy("id", "kmer").agg(F.count("*").alias("n"), F.max("pos").alias("last"))
    top = each.withColumn("r", F.rank().over(W.partitionBy("id").orderBy(F.desc("n")))).where("r = 1")
    order = S.number("kmer") if fold else F.col("last")
    place = F.row_number().over(W.partitionBy("id").orderBy(order)) - 1
    return top.select("id", "kmer", "n", place.alias("ord"))


def unique(seqs: DataFrame, k: int) -> DataFrame:
    return kmers(seqs, k, fold=True).select("id", "kmer").distinct()


def proximal_repeats(seqs: DataFrame, k: int, span: int, times: int) -> DataFrame:
    """id, kmer of those that occur ``times`` times within ``span`` symbols."""
    if times < 1:
        raise ValueError("times must be positive")
    before = F.lag("pos", times - 1).over(W.partitionBy("id", "kmer").orderBy("pos")) if times > 1 else F.col("pos")
    near = kmers(seqs, k).withColumn("d", F.col("pos") - before).where(F.col("d") <= span - k)
    return near.select("id", "kmer").distinct()


def read_break(reads: DataFrame, k: int) -> DataFrame:
    """kmer, n over all reads."""
    return kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("n"))


def read_pairs(seqs: DataFrame, k: int, d: int) -> DataFrame:
    """id, a, b, n: pairs of k-mers that stand d symbols apart."""
    at = S.read(
        lambda t: F.transform(t.starts(2 * k + d), lambda i: F.struct(t.sub(i, k).alias("a"), t.sub(i + k + d, k).alias("b"))), "seq"
    )
    return seqs.select("id", F.inline(at)).groupBy("id", "a", "b").agg(F.count("*").alias("n"))


def pair_read_break(pairs: DataFrame, k: int) -> DataFrame:
    """d, a, b, n: read pairs (d, a, b) broken into pairs of shorter ones."""
    at = S.read(lambda a, b: F.transform(a.starts(k), lambda i: F.struct(a.sub(i, k).alias("x"), b.sub(i, k).alias("y"))), "a", "b")
    broken = pairs.select((F.col("d") + F.length("a") - k).alias("d"), F.inline(at))
    return broken.groupBy("d", F.col("x").alias("a"), F.col("y").alias("b")).agg(F.count("*").alias("n"))


def composition_distance(seqs: DataFrame, k: int, fold: bool = False) -> DataFrame:
    """i, j, d: summed differences of k-mer counts for all pairs i < j of ids.

    Over a k-mer that both have, the sum of counts less twice the smaller one; so only common
    k-mers are compared.
    """
    rows = seqs.select("id", S.to_upper("seq").alias("seq")) if fold else seqs
    return block_matrix(rows, composition_kernel(k))


def min_skew(seqs: DataFrame) -> DataFrame:
    """id, pos where the running skew of G over C is least; it starts at 0."""
    run = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    each = symbols(seqs).withColumn("skew", F.sum(S.skew("sym")).over(run))
    least = F.least(F.lit(0), F.min("skew").over(W.partitionBy("id")))
    return each.withColumn("least", least).where("skew = least").select("id", "pos")


def top_with_ties(rows: DataFrame, score: Column, n: int) -> DataFrame:
    """The n rows of the highest score and those that tie with the last of them.

    The n-th score comes from a bounded top-n; no task sorts all rows.
    """
    if n < 1:
        return rows.limit(0)
    scored = rows.withColumn("__score", score)
    floor = scored.select("__score").orderBy(F.desc("__score")).limit(n).agg(F.min("__score").alias("__floor"))
    return scored.join(F.broadcast(floor), F.col("__score") >= F.col("__floor")).drop("__score", "__floor")
