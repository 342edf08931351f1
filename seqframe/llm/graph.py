"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_stage, stage_table

#: Up to so many edges (pairs of longs) the smallest neighbours are shipped; a longer table is joined by a shuffle.
SHIP_EDGES = 500_000
#: A round is written in files of about so many edges: each file costs the executors three processes of Hadoop's (chmod).
FILE_EDGES = 1 << 16
#: But in no fewer files than so many.
LEAST_FILES = 8


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written out, and their number and checksum, counted on the way."""
    seen = Observation()
    counts = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    out = stage_table(counts, "edges")
    return out, (seen.get["n"], seen.get["x"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b) of longs; root is the smallest node of its component.

    Each round is written to the shared folder, so lineage stays short; only two numbers a
    round reach the driver.  Rounds grow with the logarithm of the longest path.
    """
    own = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, mark = _written(own.distinct())
    while mark[0]:
        ship = F.broadcast if mark[0] <= SHIP_EDGES else lambda x: x
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        # larger neighbours go to the smallest of all
        large = now.select(F.col("b").alias("a"), F.col("a").alias("b")).join(ship(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        # and the smaller neighbours of a node, all it has now, to their smallest
        small = large.join(ship(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b"))
        # a round leaves about as many edges as it got
        new, after = _written(small.distinct().coalesce(max(LEAST_FILES, -(-mark[0] // FILE_EDGES))))
        drop_stage(now)
        now = new
        if after == mark:
            break
        mark = after
    # each node points at its root
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
