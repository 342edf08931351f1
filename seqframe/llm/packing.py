"""Packing into optimal length buckets and token-budget batches.

Lengths go into a histogram over all rows, in steps of ``align`` tokens.  Dynamic
programming over that histogram picks at most ``n_buckets`` boundaries such that the
padding, summed over all rows, is least when each row is padded to the boundary of its bucket;
of equal choices the one with the smaller boundaries, from the last bucket down, wins.
Inside a bucket rows follow doc_id, and a batch is as many padded rows as the token
budget holds, at least one.

A length is the UTF-8 size of the text plus one end token: the tokens of a byte-level
model.  Pass another column for another tokenizer.

Scale: the histogram has one cell for each aligned length, however many rows; the
rows are numbered by block counts, so no task sees a bucket whole: blocks of
BLOCK_ROWS rows on average, cut at quantiles of doc_id; rows without a doc_id are cut by length.

Cases: null and empty texts have length 1; null doc_ids sort first; rows that share a
doc_id are numbered by length, then arbitrarily, and those that tie are alike in the result
up to which of them is first; an empty table gives an empty result; a row longer than
the budget is a batch of its own, whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

N_BUCKETS = 8
BUDGET = 65_536
ALIGN = 64
BLOCK_ROWS = 2_000


def byte_tokens(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def boundaries(cells: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """Upper bounds of the best at most k buckets over cells (ascending lengths) with their row counts.

    Padding of rows in cells i+1..j at bound cells[j] is N(i,j) * cells[j] - S(i,j); the least
    first cell that is best moves up with j, so each layer of the table takes B log B steps.
    """
    b = len(cells)
    if not b:
        return []
    k = min(k, b)
    n = np.concatenate([[0], np.cumsum(counts)]).astype(object if counts.sum() * cells[-1] > 1 << 62 else np.int64)
    s = np.concatenate([[0], np.cumsum(counts * cells)]).astype(n.dtype)
    best = n[1:] * cells - s[1:]  # one bucket over the first j + 1 cells
    cut = np.zeros((k, b), np.int64)
    for layer in range(1, k):
        got, arg = best.copy(), cut[layer]
        # (first, last) cells to fill, and where their last-but-one bucket may end
        todo = [(layer, b - 1, layer - 1, b - 2)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(j - 1, last) + 1)
            cost = best[i] + (n[j + 1] - n[i + 1]) * cells[j] - (s[j + 1] - s[i + 1])
            at = int(np.argmin(cost))
            got[j], arg[j] = cost[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = got
    out, j = [], b - 1
    for layer in range(k - 1, -1, -1):
        out.append(int(cells[j]))
        j = int(cut[layer][j])
    return out[::-1]


def histogram(rows: DataFrame, align: int) -> tuple[np.ndarray, np.ndarray]:
    """Aligned lengths and their counts; its size is that of the longest text over ``align``, not of the table."""
    cell = F.ceil(F.col("n_tokens") / align) * align
    got = rows.groupBy(cell.cast("long").alias("cell")).count().orderBy("cell").collect()
    return np.array([r["cell"] for r in got], np.int64), np.array([r["count"] for r in got], np.int64)


def numbered(rows: DataFrame, key: str, total: int) -> DataFrame:
    """Adds ``row`` (from 0, in each ``key``, by doc_id) without a task that sees a key whole."""
    n_blocks = max(1, min(4096, math.ceil(total / BLOCK_ROWS)))
    cuts = rows.approxQuantile("doc_id", [k / n_blocks for k in range(1, n_blocks)], 0.2 / n_blocks) if n_blocks > 1 else []
    cuts = sorted({int(c) for c in cuts})
    block = F.lit(0)
    if cuts:
        block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.coalesce(F.col("doc_id"), F.lit(cuts[0]))))
    # rows without a doc_id come first, by length
    part = F.when(F.col("doc_id").isNull(), F.col("n_tokens")).otherwise(F.lit((1 << 63) - 1))
    rows = rows.withColumn("block", block).withColumn("part", part)
    sizes = rows.groupBy(key, "block", "part").agg(F.count("*").alias("rows"))
    # at most n_blocks rows a key, and one for each length of rows without a doc_id
    before = F.coalesce(F.sum("rows").over(W.partitionBy(key).orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select(key, "block", "part", before.alias("before"))
    own = F.row_number().over(W.partitionBy(key, "block", "part").orderBy("doc_id", "n_tokens"))
    placed = rows.withColumn("own", own).join(firsts, [key, "block", "part"])
    return placed.withColumn("row", F.col("before") + F.col("own") - 1).drop("own", "before", "block", "part")


def pack(
    docs: DataFrame,
    length: Column | None = None,
    n_buckets: int = N_BUCKETS,
    budget: int = BUDGET,
    align: int = ALIGN,
) -> DataFrame:
    """doc_id, n_tokens, bucket (from 0), padded_to, batch (from 0 in its bucket), slot (place in the batch)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (byte_tokens(F.col("text")) if length is None else length.cast("long")).alias("n_tokens")
    )
    cells, counts = histogram(rows, align)
    bounds = boundaries(cells, counts, n_buckets) or [align]
    bucket = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x < F.col("n_tokens")))
    rows = rows.withColumn("bucket", bucket)
    got = numbered(rows, "bucket", int(counts.sum()))
    to = F.element_at(F.array(*[F.lit(x) for x in bounds]), F.col("bucket") + 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / to))
    return got.select(
        "doc_id",
        "n_tokens",
        F.col("bucket").cast("long").alias("bucket"),
        to.cast("long").alias("padded_to"),
        F.floor(F.col("row") / room).cast("long").alias("batch"),
        (F.col("row") % room).cast("long").alias("slot"),
    )


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def oracle_sql(source: str = "documents", n_buckets: int = N_BUCKETS, budget: int = BUDGET, align: int = ALIGN) -> str:
    """The same for DuckDB: one table of the dynamic programme for each number of buckets."""
    layers = ["d1 AS (SELECT j, n * cell - s AS cost, CAST([cell] AS BIGINT[]) AS bounds FROM h)"]
    for k in range(2, n_buckets + 1):
        layers.append(
            f"d{k} AS (SELECT b.j, min(a.cost + (b.n - i.n) * b.cell - (b.s - i.s)) AS cost,"
            f" list_append(arg_min(a.bounds, (a.cost + (b.n - i.n) * b.cell - (b.s - i.s), a.j)), any_value(b.cell)) AS bounds"
            f" FROM h b JOIN d{k - 1} a ON a.j < b.j JOIN h i ON i.j = a.j GROUP BY b.j)"
        )
    every = " UNION ALL ".join(f"SELECT {k} AS k, bounds FROM d{k} WHERE j = (SELECT max(j) FROM h)" for k in range(1, n_buckets + 1))
    return f"""
WITH r AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS n_tokens FROM {source}),
c AS (SELECT CAST(ceil(n_tokens / {align}.0) * {align} AS BIGINT) AS cell, count(*) AS rows FROM r GROUP BY 1),
h AS (SELECT row_number() OVER (ORDER BY cell) AS j, cell, CAST(sum(rows) OVER (ORDER BY cell) AS BIGINT) AS n,
  CAST(sum(rows * cell) OVER (ORDER BY cell) AS BIGINT) AS s FROM c),
{", ".join(layers)},
best AS (SELECT arg_max(bounds, k) AS bounds FROM ({every})),
p AS (SELECT doc_id, n_tokens, CAST(len(list_filter(bounds, lambda x: x < n_tokens)) AS BIGINT) AS bucket, bounds FROM r, best),
q AS (SELECT doc_id, n_tokens, bucket, bounds[bucket + 1] AS padded_to,
  greatest(1, {budget} // bounds[bucket + 1]) AS room,
  row_number() OVER (PARTITION BY bucket ORDER BY doc_id, n_tokens) - 1 AS row FROM p)
SELECT doc_id, n_tokens, bucket, CAST(padded_to AS BIGINT) AS padded_to,
  CAST(row // room AS BIGINT) AS batch, CAST(row % room AS BIGINT) AS slot FROM q
"""
