"""Searches in sequences that give rows: sites of peptides, reading frames, suffix indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batch
from ..functions import seq as S
from ..functions.suffix import Occurrences, codes, suffix_array


def frames(seqs: DataFrame) -> DataFrame:
    """id, strand (1 or -1), frame, n (symbols), residues of the six reading frames."""
    both = F.array(F.struct(F.lit(1).alias("strand"), F.col("seq").alias("s")), F.struct(F.lit(-1).alias("strand"), S.reverse_complement8("seq").alias("s")))
    rows = seqs.select("id", F.inline(both))
    each = F.array(*[F.struct(F.lit(f).alias("frame"), S.residues("s", f).alias("residues")) for f in range(3)])
    return rows.select("id", "strand", F.length("s").alias("n"), F.inline(each))


def peptide_sites(seqs: DataFrame, peptide: str, distinct: bool = False) -> DataFrame:
    """id, pos, strand of sites that read the peptide; ``distinct``: id, pos, each place once."""
    if not peptide:
        raise ValueError("an empty peptide has no sites")
    kind = seqs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, code, lengths in batch.pieces(batches):
            text, pos, strand = batch.peptide_sites(code, lengths, peptide)
            if distinct and len(text):
                text, pos = np.divmod(np.unique(text * len(code) + pos), len(code))
            columns = [b.column(0).take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(strand.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns[:2], ["id", "pos"]) if distinct else pa.RecordBatch.from_arrays(columns, ["id", "pos", "strand"])

    sites = seqs.select("id", "seq").mapInArrow(run, f"id {kind}, pos int" + ("" if distinct else ", strand int"))
    # rows of one id count together
    return sites.distinct() if distinct else sites


def open_reading_frames(seqs: DataFrame) -> DataFrame:
    """id, peptide: the distinct peptides from any start codon of either strand to a stop."""
    # what stands before a stop, cut into the tails from each start codon
    pieces = F.split("residues", F.lit("\\*"), -1)
    closed = frames(seqs).select("id", F.explode(S.let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))).alias("t"))
    closed = closed.where(F.instr("t", "M") > 0).distinct()
    tails = S.read(lambda t: F.transform(F.filter(t.starts(1), lambda i: t.at(i) == "M"), lambda i: t.sub(i, t.length)), "t")
    return closed.select("id", F.explode(tails).alias("peptide")).distinct()


def full_text_index(seqs: DataFrame, sentinel: str = "$") -> DataFrame:
    """id, sa, bwt, symbols, firsts, places: the suffix array and transform of each text and where each symbol
    stands in it; a sentinel is added where it is missing.  Build it once and search it often; a text is indexed in one task, in
    memory in proportion to its length."""
    kind = seqs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py()
                text = text if text.endswith(sentinel) else text + sentinel
                sa = suffix_array(codes(text))
                bwt = "".join([text[i - 1] for i in sa.tolist()])
                columns = [[sa], [bwt], *([x] for x in Occurrences.of(bwt))]
                kinds = [pa.list_(pa.int32()), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32()))]
                own = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *own], ["id", "sa", "bwt", "symbols", "firsts", "places"])

    shape = f"id {kind}, sa array<int>, bwt string, symbols string, firsts array<int>, places array<array<int>>"
    return seqs.where(F.col("seq").isNotNull()).select("id", "seq").mapInArrow(run, shape)


def suffix_index(seqs: DataFrame, sentinel: str = "$") -> DataFrame:
    """id, rank, sa, bwt: a row for each suffix of each text, in order; a sentinel is added where it is missing."""
    # the array and the transform run side by side
    pairs = full_text_index(seqs, sentinel).select("id", F.posexplode(F.arrays_zip("sa", S.symbols("bwt").alias("bwt"))).alias("rank", "x"))
    return pairs.select("id", "rank", "x.sa", "x.bwt")


def search_index(index: DataFrame, pattern: str) -> DataFrame:
    """id, pos, ord: occurrences in the order of their suffixes, by backward search over a ``full_text_index``; symbols
    that the text does not hold match nothing."""
    if not pattern:
        raise ValueError("an empty pattern")
    kind = index.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                symbols, firsts = b.column(2)[k].as_py(), b.column(3)[k].as_py()
                places = [x.values.to_numpy() for x in b.column(4)[k]]
                sa = b.column(1)[k].values
                low, high = Occurrences(symbols, firsts, places).range(pattern, len(sa))
                ids = pa.array([b.column(0)[k].as_py()] * (high - low), b.schema.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, sa.slice(low, high - low), pa.array(range(high - low), pa.int32())], ["id", "pos", "ord"])

    return index.select("id", "sa", "symbols", "firsts", "places").mapInArrow(run, f"id {kind}, pos int, ord int")


def index_search(seqs: DataFrame, pattern: str, sentinel: str = "$") -> DataFrame:
    """``search_index`` over indexes built for the one search, which are not written out: many texts are indexed at once."""
    if not pattern:
        raise ValueError("an empty pattern")
    kind = seqs.schema["id"].dataType.simpleString()
    closed = F.when(F.endswith("seq", F.lit(sentinel)), F.col("seq")).otherwise(F.concat("seq", F.lit(sentinel)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, code, lengths in batch.pieces(batches):
            sa = batch.suffix_arrays(code, lengths)
            low, high = batch.backward_search(code, lengths, sa, pattern)
            n = np.maximum(high - low, 0)
            text = np.repeat(np.arange(len(n)), n)
            ord_ = np.arange(len(text)) - (np.cumsum(n) - n)[text]
            pos = sa[(np.cumsum(lengths) - lengths + low)[text] + ord_]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(pos.astype(np.int32)), pa.array(ord_.astype(np.int32))], ["id", "pos", "ord"])

    return seqs.select("id", closed.alias("seq")).mapInArrow(run, f"id {kind}, pos int, ord int")


def is_uniform(seqs: DataFrame) -> DataFrame:
    """uniform: there is a sequence and all have one length."""
    return seqs.agg(((F.count("*") > 0) & (F.min(F.length("seq")) == F.max(F.length("seq")))).alias("uniform"))


def longest(seqs: DataFrame) -> DataFrame:
    """n: greatest length, -1 without sequences."""
    return seqs.agg(F.coalesce(F.max(F.length("seq")), F.lit(-1)).alias("n"))
