"""Document fingerprints after I-Match.

Terms are runs of letters and digits of the lower-cased text.  The lexicon is all terms
whose inverse document frequency over the whole corpus, ln(N / df), lies in [IDF_MIN, IDF_MAX].
A text keeps its distinct lexicon terms, sorted, and each of SUBSETS
randomised lexicon subsets is hashed over the kept terms that it holds.  Subset s holds
each term with probability 2 to the power -(1 + s mod RATES): the sparse ones survive edits of long
texts, the dense ones tell short texts apart.  The likeness of two fingerprints is the share of
equal hashes among the subsets that hit at least one of both, from the sparsest rate up
to the one at which ENOUGH subsets hit.

Cases: a text with fewer than LEAST lexicon terms uses all its distinct terms; a text
without terms (null, empty) has an all-zero fingerprint, and two such are alike 1.0; equal texts
have equal fingerprints; rows that share a doc_id follow each other in a fixed order;
null doc_ids come first; an empty table gives no rows.

Scale: document frequencies are summed in each batch before the shuffle.  The lexicon has
at most (mean distinct terms of a text) * exp(IDF_MAX) terms, whatever the number of texts,
so it can be shipped.  The texts themselves move once, compressed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import block_column, documents, per_worker, table
from .words import word_hashes

IDF_MIN = math.log(5)  # in a fifth of all texts at most
IDF_MAX = math.log(2000)  # in one of 2,000 at least
SUBSETS, RATES = 96, 12
ENOUGH = 24
LEAST = 4
BLOCK_ROWS = 2_000
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"subset %d" % s) | 1 for s in range(SUBSETS)], np.uint64)
_SHIFT = np.array([63 - s % RATES for s in range(SUBSETS)], np.uint64)


def terms(text: str) -> np.ndarray:
    """Distinct terms as ascending 64-bit hashes."""
    return np.unique(word_hashes(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED)))


def members(term: np.ndarray) -> np.ndarray:
    """Which subsets hold each term: a row for each term."""
    with np.errstate(over="ignore"):
        x = (term[:, None] ^ (term[:, None] >> np.uint64(29))) * _SEEDS
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x >> _SHIFT == 0


class Lexicon:
    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        row, self.subset = np.nonzero(members(self.hashes))
        self.first = np.searchsorted(row, np.arange(len(self.hashes) + 1))
        self.power = np.ones(1024, np.uint64)
        self._grow(1024)

    def _grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)

    def fingerprint(self, text: str) -> np.ndarray:
        """16 bits of each subset's hash; 0: it holds no term of the text."""
        own = terms(text)
        k = np.searchsorted(self.hashes, own)
        k[k == len(self.hashes)] = 0
        hit = self.hashes[k] == own if len(self.hashes) else np.zeros(len(own), bool)
        if hit.sum() >= LEAST:
            kept, k = own[hit], k[hit]
            n = self.first[k + 1] - self.first[k]
            row = np.repeat(np.arange(len(k)), n)
            subset = self.subset[np.arange(len(row)) + np.repeat(self.first[k] - np.cumsum(n) + n, n)]
        else:
            kept = own
            row, subset = np.nonzero(members(own))
        out = np.zeros(SUBSETS, np.uint16)
        if not len(row):
            return out
        if len(kept) >= len(self.power):
            self._grow(2 * len(kept))
        # a polynomial over the sorted terms of each subset
        order = np.argsort(subset.astype(np.uint8), kind="stable")
        subset = subset[order]
        used, start = np.unique(subset, return_index=True)
        place = np.arange(len(subset)) - np.repeat(start, np.diff(np.append(start, len(subset))))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(kept[row[order]] * self.power[place], start)
            sums = (sums ^ (sums >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        out[used] = np.maximum(sums >> np.uint64(48), 1)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    some = ((a > 0) | (b > 0)).reshape(-1, RATES)[:, ::-1]
    same = ((a == b) & (a > 0)).reshape(-1, RATES)[:, ::-1]
    hits, equal = np.cumsum(some.sum(axis=0)), np.cumsum(same.sum(axis=0))
    if not hits[-1]:
        return 1.0
    k = int(np.searchsorted(hits, min(ENOUGH, hits[-1])))
    return float(equal[k] / hits[k])


def text_form(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (hash) and df over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [terms(t or "") for t in b.column(0).to_pylist()]
            got, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0))
            yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(n.astype(np.int32))], ["term", "df"])

    return docs.select("text").mapInArrow(run, "term long, df int").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, total: int) -> np.ndarray:
    """Hashes of the terms in the band; bounded as the module says."""
    idf = F.log(F.lit(float(total)) / F.col("df"))
    kept = document_frequencies(docs).where((idf >= IDF_MIN) & (idf <= IDF_MAX)).select("term")
    got = kept.toArrow().column(0).to_numpy()
    return np.sort(got.astype(np.int64).view(np.uint64))


_lexicon = per_worker(lambda raw: Lexicon(np.frombuffer(raw, np.uint64)))


def with_next(docs: DataFrame, total: int) -> DataFrame:
    """doc_id, text and next_text, both compressed, of (doc_id, text): the next row by doc_id, after the last the first.

    Blocks of consecutive rows are sorted apart; each also gets the first row of the block after it.
    """

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1, write_checksum=False)
        for b in batches:
            packed = [z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(packed, pa.binary())], ["block", "k", "doc_id", "z"])

    spark = docs.sparkSession
    block = block_column(docs, "doc_id", total, BLOCK_ROWS)
    rows = docs.select(block.alias("block"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "doc_id", "text")
    shape = "block int, k long, doc_id long, z binary"
    # at most 4,096 blocks
    least = sorted((r["block"], r["k"]) for r in rows.groupBy("block").agg(F.min("k").alias("k")).collect())
    before = {b: least[i - 1][0] for i, (b, _) in enumerate(least)}
    heads = spark.createDataFrame([(before[b], b, k) for b, k in least], "block int, b int, k long")
    heads = rows.withColumnRenamed("block", "b").join(F.broadcast(heads), ["b", "k"])
    heads = heads.select("block", "k", "doc_id", "text").mapInArrow(squeeze, shape).groupBy("block").agg(F.min("z").alias("z"))
    own = rows.mapInArrow(squeeze, shape).withColumn("extra", F.lit(False))
    heads = heads.select("block", F.lit(0).cast("long").alias("k"), F.lit(None).cast("long").alias("doc_id"), "z", F.lit(True).alias("extra"))
    after = F.lead("z").over(W.partitionBy("block").orderBy("extra", "k", "z"))
    return own.unionByName(heads).withColumn("next", after).where(~F.col("extra")).select("doc_id", "z", "next")


def edited(text: str, after: str) -> str:
    """The last quarter (floor) replaced by as many first characters of the next text, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the next text's."""
    total = docs.count()
    if not total:
        return docs.sparkSession.createDataFrame([], OUT)
    words = docs.sparkSession.sparkContext.broadcast(lexicon(docs, total).tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, z = _lexicon(words.value), zstandard.ZstdDecompressor()
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(SUBSETS, np.uint16))

        def of(packed: bytes) -> tuple[str, np.ndarray]:
            text = z.decompress(packed).decode("utf-8", "surrogatepass")
            return text, known[1] if known[0] == packed else lex.fingerprint(text)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc, own, after in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    text, a = of(own)
                    # the row that follows here is most often the next text
                    follow, c = (text, a) if after == own else of(after)
                    known = (after, c)
                    new = edited(text, follow)
                    e = lex.fingerprint(new)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc, len(text), sha, text_form(a), text_form(e), likeness(a, e), likeness(a, c)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                names = [c.split()[0] for c in OUT.split(", ")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names
                )

    return with_next(docs, total).mapInArrow(run, OUT)


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare(documents(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
