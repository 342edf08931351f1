"""Distance matrices and joins by nearness of values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import seq as S
from .stages import parts

#: Sequences and bytes of a block, pairs compared at once.
BLOCK, BLOCK_BYTES, CELLS = 1024, 1 << 22, 1 << 19


def matrix(seqs: DataFrame, metric: Callable[[Column, Column], Column], full: bool = False) -> DataFrame:
    """i, j, d for all pairs i < j of ids (``full``: both orders and the diagonal 0).

    The result itself is quadratic in the table; the metric runs once for each pair.
    """
    x = seqs.select(F.col("id").alias("i"), F.col("seq").alias("s"))
    y = seqs.select(F.col("id").alias("j"), F.col("seq").alias("t"))
    half = x.join(y, F.col("i") < F.col("j")).select("i", "j", metric(F.col("s"), F.col("t")).alias("d"))
    if not full:
        return half
    zero = seqs.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0).alias("d"))
    return half.unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(zero)


def block_matrix(seqs: DataFrame, kernel, kind: str = "long") -> DataFrame:
    """i, j, d for all pairs i < j of whole-number ids by a symmetric metric of ``functions.pairs``.

    The result is quadratic in the table; sequences meet block by block, in memory for some CELLS pairs, and the pairs of
    blocks are dealt over tasks.  Nothing but the blocks is shuffled.
    """
    spark = seqs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    rows = seqs.where("id is not null")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("seq")), F.lit(0))).first()
    # small tables are cut finer, so that all cores have work
    blocks = max(-(-n // BLOCK), -(-size // BLOCK_BYTES), min(-(-n // 64), int((8 * cores) ** 0.5)), 1)
    held = rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    held = held.agg(F.collect_list(F.struct("id", "seq")).alias("x")).select("b", F.col("x.id").alias("ids"), F.col("x.seq").alias("seqs"))
    left = held.select("b", F.col("ids").alias("i"), F.col("seqs").alias("s"), F.explode(F.sequence(F.col("b"), F.lit(blocks - 1))).alias("c"))
    right = held.select(F.col("b").alias("c"), F.col("ids").alias("j"), F.col("seqs").alias("t"))
    pairs = blocks * (blocks + 1) // 2
    work = left.join(right, "c").select((F.col("b") == F.col("c")).alias("same"), "i", "s", "j", "t").repartition(min(pairs, max(4 * cores, pairs // 4)))
    arrow = {"long": pa.int64(), "double": pa.float64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                i, j = (b.column(c)[k].values.to_numpy() for c in (1, 3))
                s, t = (b.column(c)[k].values.to_pylist() for c in (2, 4))
                step = max(1, CELLS // max(len(j), 1))
                for low in range(0, len(i), step):
                    d = kernel(s[low : low + step], t).ravel()
                    x, y = np.repeat(i[low : low + step], len(j)), np.tile(j, len(i[low : low + step]))
                    keep = x < y if b.column(0)[k].as_py() else x != y
                    if not keep.all():
                        x, y, d = x[keep], y[keep], d[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(d, arrow)], ["i", "j", "d"])

    return work.mapInArrow(run, f"i {seqs.schema['id'].dataType.simpleString()}, j {seqs.schema['id'].dataType.simpleString()}, d {kind}")


def motif_total(seqs: DataFrame, motif: str) -> DataFrame:
    """hamming: least distances of the motif to the windows of each sequence, summed."""
    return seqs.agg(F.coalesce(F.sum(S.motif_hamming("seq", motif)), F.lit(0)).cast("long").alias("hamming"))


def _place(v: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at most v: first among every so many of them, then among those that follow."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda values: F.size(F.filter(values, lambda c: c <= v))
    row = lambda values: F.array(*[F.lit(float(c)) for c in values])
    first = below(row([g[0] for g in groups]))
    return S.let(first, lambda k: F.when(k > 0, (k - 1) * step + below(F.element_at(F.array(*[row(g) for g in groups]), F.greatest(k, F.lit(1))))).otherwise(0))


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, x, nearest, d: for each (key, x) the closest value (value) of the right; equally close: the greater.

    One sort of both sides by value range and two running values; no pairs are made.  The ranges
    are cut where the values of both sides lie, in number as these grow.
    """
    values = left.select(F.col("x").alias("value")).unionByName(right.select("value"))
    n = parts(values)
    cuts = sorted(set(values.approxQuantile("value", [k / n for k in range(1, n)], min(0.005, 0.25 / n))))
    block = lambda v: _place(v, cuts)
    r = right.select(F.lit(None).alias("key"), F.col("value").alias("v"), F.lit(0).alias("side"), block(F.col("value")).alias("b"))
    # every block also gets the greatest value below it and the least above it
    ends = r.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = W.orderBy("b")  # a row for each block
    blocks = right.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("b")).join(ends, "b", "left")
    edges = blocks.select(
        "b",
        F.last("hi", True).over(w.rowsBetween(W.unboundedPreceding, -1)).alias("below"),
        F.first("lo", True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("above"),
    )
    extra = edges.select("b", F.explode(F.array("below", "above")).alias("v")).where("v is not null")
    rows = left.select("key", F.col("x").alias("v"), F.lit(1).alias("side"), block(F.col("x")).alias("b"))
    both = rows.unionByName(r.withColumn("key", F.lit(None).cast(left.schema["key"].dataType))).unionByName(
        extra.select(F.lit(None).cast(left.schema["key"].dataType).alias("key"), "v", F.lit(0).alias("side"), "b")
    )
    both = both.repartition(n, "b")
    value = F.when(F.col("side") == 0, F.col("v"))
    down = W.partitionBy("b").orderBy("v", "side").rowsBetween(W.unboundedPreceding, 0)
    up = W.partitionBy("b").orderBy(F.desc("v"), "side").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("lo", F.last(value, True).over(down)).withColumn("hi", F.last(value, True).over(up)).where("side = 1")
    x, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    pick = F.when(lo.isNull() | (hi - x <= x - lo), hi).otherwise(lo)
    return found.select("key", x.alias("x"), pick.alias("nearest")).withColumn("d", F.abs(F.col("x") - F.col("nearest")))


def overlap(measured: DataFrame, theory: DataFrame, width: float) -> DataFrame:
    """spec_id, n: theoretical masses (spec_id, ord, mass) with a measured one (spec_id, mass) within ``width``.

    An equi-join on cells of that width and their neighbours, not a range join.
    """
    cell = lambda m: F.floor(m / width)
    m = measured.select("spec_id", F.col("mass").alias("m"), cell(F.col("mass")).alias("cell")).distinct()
    t = theory.select("spec_id", "ord", F.col("mass").alias("t"), F.explode(F.array(*[cell(F.col("mass")) + k for k in (-1, 0, 1)])).alias("cell"))
    hit = t.join(m, ["spec_id", "cell"]).where(F.abs(F.col("m") - F.col("t")) <= width)
    n = hit.groupBy("spec_id").agg(F.count_distinct("ord").alias("n"))
    return theory.select("spec_id").distinct().join(n, "spec_id", "left").select("spec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _dealt(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = parts(a) if a is b else parts(a, b)
    return a.repartition(n, "spec_id"), b.repartition(n, "spec_id")


def convolution(a: DataFrame, b: DataFrame) -> DataFrame:
    """spec_id, diff, n: how often each difference b - a of masses occurs; (spec_id, mass) rows are counted first.

    Both tables are dealt by spectrum once, over tasks that grow in number with them."""
    a, b = _dealt(a, b)
    ca = a.groupBy("spec_id", F.col("mass").alias("ma")).agg(F.count("*").alias("na"))
    cb = b.groupBy("spec_id", F.col("mass").alias("mb")).agg(F.count("*").alias("nb"))
    return ca.join(cb, "spec_id").groupBy("spec_id", (F.col("mb") - F.col("ma")).alias("diff")).agg(F.sum(F.col("na") * F.col("nb")).alias("n"))


def modal_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """spec_id, diff, n: the most frequent difference; of equal ones the smallest."""
    return convolution(a, b).groupBy("spec_id").agg(F.max_by("diff", F.struct("n", -F.col("diff"))).alias("diff"), F.max("n").alias("n"))


def self_convolution(spectra: DataFrame) -> DataFrame:
    """spec_id, diff, n of the positive differences."""
    return convolution(spectra, spectra).where("diff > 0")


def common_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """spec_id, n: size of the multiset intersection of two tables (spec_id, mass)."""
    side = lambda t, k: t.where("mass is not null and spec_id is not null").select("spec_id", "mass", F.lit(k).alias("side"))
    both = side(a, 0).unionByName(side(b, 1)).repartition(parts(a, b), "spec_id")
    n = both.groupBy("spec_id", "mass").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    return n.where("na > 0 and nb > 0").groupBy("spec_id").agg(F.sum(F.least("na", "nb")).alias("n"))
