"""A training corpus from ``documents``: toxic and unreadable texts go, one of each group of
near copies stays, benchmark passages go, and what is left is packed into batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``docs``.  Null texts count as empty: they are not toxic, but have no
language, so the second stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqframe.llm import jaccard, langid, packing, tiling, toxicity
from seqframe.llm.common import own_name, stage_table, table

#: Up to so many keys of rows (a long each) are shipped; more are joined by a shuffle.
SHIP_KEYS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores below 0.5; the scorer learns from the labelled rows of ``docs``."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in one of the languages that ``docs`` are labelled with."""
    return langid.keep_known(docs, langid.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each group of near copies: sets of five words, similarity 0.8 or more.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, stay unless their
    texts are near copies; of rows equal in both, the one that sorts first by all its columns stays.
    """
    key = own_name(docs, "__row")
    rows = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    groups = jaccard.join(rows.select(F.col(key).alias("doc_id"), "text"), 5, 80, 100)
    groups = groups.select(F.col("doc_id").alias("row"), "component_id").distinct()
    ids = rows.select(F.col(key).alias("row"), F.col("doc_id").alias("id")).distinct()
    order = F.struct(F.col("id").isNull(), "id", "row")
    first = groups.join(ids, "row").groupBy("component_id").agg(F.min(order)["row"].alias("first"))
    gone = stage_table(groups.join(first, "component_id").where(F.col("row") != F.col("first")).select(F.col("row").alias(key)), "gone")
    kept = rows.join(F.broadcast(gone) if gone.count() <= SHIP_KEYS else gone, key, "left_anti")
    again = stage_table(rows.groupBy(key).count().where("count > 1").select(key), "again")
    repeated = again.count()
    if repeated:
        # rows equal in doc_id and text: few, and only these meet
        again = F.broadcast(again) if repeated <= SHIP_KEYS else again
        place = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
        one = kept.join(again, key, "left_semi").withColumn("__place", place).where("__place = 1").drop("__place")
        kept = kept.join(again, key, "left_anti").unionByName(one)
    return kept.select(docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, in whatever order its parts stand."""
    return tiling.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the kept documents; see ``packing.pack`` for the columns."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: SQL cannot train or run the classifiers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
