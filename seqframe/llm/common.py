"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null text reads as empty), whatever else the table holds."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def own_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have yet."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """Every fifth document by CRC-32 of its id written as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is set, a session in one process (tests, a laptop) gets a local one; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="seqframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def block_column(rows: DataFrame, key: str, total: int, per_block: int, most: int = 4096) -> Column:
    """A block number that ascends with the long column ``key``: blocks of ``per_block`` rows on
    average, cut at its quantiles (nulls with the first block), ``most`` blocks at most."""
    n = max(1, min(most, -(-total // per_block)))
    cuts = rows.approxQuantile(key, [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    cuts = sorted({int(c) for c in cuts})
    if not cuts:
        return F.lit(0)
    value = F.coalesce(F.col(key), F.lit(cuts[0]))
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < value))


def stage_table(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends here, and a
    lost executor costs only the reread of its files.  ``codec`` names a compression other than the session's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqframe/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    # the schema is known, so that an empty result is readable too
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store with all it holds."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stage(df: DataFrame) -> None:
    """Remove the files of a staged table that no later step reads."""
    for folder in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        drop_folder(df.sparkSession, folder)


def per_worker(make: Callable, most: int = 8):
    """Memoise ``make`` in each Python worker (key: its arguments), for the last ``most`` keys."""
    memo: dict = {}

    def get(*key):
        if key not in memo:
            while len(memo) >= most:
                del memo[next(iter(memo))]
            memo[key] = make(*key)
        return memo[key]

    return get
