"""Tables written to the shared folder between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where none is set, a session in one process (tests, a laptop) gets a local one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="seqframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame) -> DataFrame:
    """Write and read back: lineage ends here."""
    path = f"{folder(df.sparkSession)}/seqframe/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a partition by key.
ROWS = 250_000


def parts(*tables: DataFrame) -> int:
    """Partitions for work by key on the tables: as many as usual, and more as they grow, so that a task's rows stay few."""
    usual = int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(usual, -(-max(x.count() for x in tables) // ROWS))


def numbered(rows: DataFrame, *keys: str, name: str = "ord") -> DataFrame:
    """Adds each row's place (from 0) in the order of the keys: ranges are sorted apart, and counts of whole ranges added."""
    at, part = "__at", "__part"
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    ordered = stage(ordered).withColumn(part, F.shiftright(at, 33))
    # a row for each range
    sizes = ordered.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select(part, before.alias("before"))
    place = F.col("before") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(F.broadcast(first), part).withColumn(name, place).drop(at, part, "before")
