"""The corpus pipeline on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from seqframe.llm.common import stage_table

DATA = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_drop_copies(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    copies = docs.unionByName(docs.limit(5))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = copies.count()
        copies = stage_table(stage(spark, copies, DATA), name)
        assert copies.columns == columns and 0 < copies.count() <= before
    assert copies.groupBy("doc_id").count().where("count > 1").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, copies, DATA)
    assert packed.count() == copies.count()


def test_near_copies_of_rows_that_share_or_lack_ids(spark):
    a, b, c = "one two three four five six seven eight nine ten", "other words in quite another text than that first", "third text stands all alone here and stays"
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (1, a, "y"), (2, a, "x"), (None, b, "x"), (None, c, "x"), (3, None, "x"), (4, "", "x"), (3, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("row", F.lit(1)).withColumn("component_id", F.lit(2))
    got = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert got.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (None, c), (3, None), (4, "")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), DATA).count() == 0


def test_a_corpus_of_null_and_empty_texts_and_none_at_all(spark, tmp_path):
    for name, n in (("some", 4), ("none", 0)):
        folder = tmp_path / name
        folder.mkdir()
        docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, None, None, None, None), (3, "\n", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
        docs.limit(n).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(folder)).count() == 0
