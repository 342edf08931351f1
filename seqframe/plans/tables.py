"""Sequences, peptides, spectra and trees derived from the given tables, in Spark and in SQL.

Both forms of a table hold the same rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEX = "0123456789abcdef"
BASE16 = "ACTGACTGACTGACTG"
RESIDUE16 = "ACDEFGHIKLMNPQRS"


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str, parallel: int | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self.parallel = parallel or spark.sparkContext.defaultParallelism

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows dealt over ``parallel`` tasks where the files have fewer splits: the expressions on them take far longer than the shuffle."""
        return df.repartition(self.parallel) if df.rdd.getNumPartitions() < self.parallel else df

    def _mers(self, table: str, key: str) -> DataFrame:
        text = F.translate(F.md5(F.col(key).cast("string").cast("binary")), HEX, BASE16)
        return self.spread(self.read(table).select(F.col(key))).select(F.col(key).cast("long").alias("id"), text.alias("seq"))

    @cached_property
    def dna(self) -> DataFrame:
        """Plain DNA of mixed case and any length: the A, C, G, T of each document."""
        text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^ACGTacgt]", "")
        return self.spread(self.read("documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), text.alias("seq"))

    @cached_property
    def orders(self) -> DataFrame:
        """32-mers, one for each order."""
        return self._mers("orders", "o_orderkey")

    @cached_property
    def suppliers(self) -> DataFrame:
        return self._mers("supplier", "s_suppkey")

    @cached_property
    def nations(self) -> DataFrame:
        return self._mers("nation", "n_nationkey")

    @cached_property
    def peptides(self) -> DataFrame:
        """Peptides of 32 residues, one for each part."""
        text = F.translate(F.md5(F.col("p_partkey").cast("string").cast("binary")), HEX, RESIDUE16)
        return self.spread(self.read("part").select("p_partkey")).select(F.col("p_partkey").alias("id"), text.alias("seq"))

    @cached_property
    def spectra(self) -> DataFrame:
        """Integer masses of each order: the quantities of its lines."""
        return self.read("lineitem").select(F.col("l_orderkey").alias("spec_id"), F.col("l_quantity").cast("int").alias("mass"))

    @cached_property
    def tree(self) -> DataFrame:
        """The world: node 0, regions from 1, nations from 6, weights by key."""
        r = self.read("region").select((F.col("r_regionkey") + 1).alias("node"), F.lit(0).alias("parent"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 0.5).alias("weight"))
        n = self.read("nation").select((F.col("n_nationkey") + 6).alias("node"), (F.col("n_regionkey") + 1).alias("parent"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 0.25 + 1).alias("weight"))
        root = self.spark.range(1).select(F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit("WORLD").alias("name"), F.lit(None).cast("double").alias("weight"))
        return root.unionByName(r).unionByName(n).withColumn("tree_id", F.lit(0))

    @cached_property
    def customer_tree(self) -> DataFrame:
        """The same with customers below their nations, from node 31."""
        c = self.read("customer").select((F.col("c_custkey") + 31).cast("int").alias("node"), (F.col("c_nationkey") + 6).alias("parent"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("weight"), F.lit(0).alias("tree_id"))
        return self.tree.unionByName(c)


def _sql_mers(table: str, key: str) -> str:
    return f"SELECT CAST({key} AS BIGINT) AS id, translate(md5(CAST({key} AS VARCHAR)), '{HEX}', '{BASE16}') AS s FROM {table}"


SQL = {
    "dna": "SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '', 'g') AS s FROM documents",
    "mers": _sql_mers("orders", "o_orderkey"),
    "supp": _sql_mers("supplier", "s_suppkey"),
    "nat": _sql_mers("nation", "n_nationkey"),
    "pep": f"SELECT p_partkey AS id, translate(md5(CAST(p_partkey AS VARCHAR)), '{HEX}', '{RESIDUE16}') AS s FROM part",
    "spec": "SELECT l_orderkey AS spec_id, CAST(l_quantity AS INT) AS mass FROM lineitem",
    "tree": "SELECT 0 AS node, CAST(NULL AS INT) AS parent, 'WORLD' AS name, CAST(NULL AS DOUBLE) AS weight"
    " UNION ALL SELECT r_regionkey + 1, 0, r_name, r_regionkey + 0.5 FROM region"
    " UNION ALL SELECT n_nationkey + 6, n_regionkey + 1, n_name, n_nationkey * 0.25 + 1 FROM nation",
    "ctree": "SELECT * FROM tree UNION ALL SELECT CAST(c_custkey + 31 AS INT), c_nationkey + 6, c_name, c_acctbal FROM customer",
}


def kmers_sql(source: str, k: int, fold: bool = False) -> str:
    s = "upper(s)" if fold else "s"
    return f"SELECT id, i - 1 AS pos, substr({s}, i, {k}) AS kmer FROM (SELECT id, s, unnest(range(1, length(s) - {k} + 2)) AS i FROM {source})"


def with_sql(*names: str, **more: str) -> str:
    """A WITH clause of derived tables by name, then of others."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({q})" for n, q in [*((n, SQL[n]) for n in names), *more.items()]) + "\n"


REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Callable[[Tables], DataFrame]):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add
