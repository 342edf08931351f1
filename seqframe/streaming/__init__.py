"""Streaming forms: running profiles and k-mer counts, and a peptide search over chunks of a genome."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kmers import kmers
from ..operators.profile import count_profile


def running_profile(seqs: DataFrame) -> DataFrame:
    """Count profile of all sequences so far (output mode complete or update)."""
    return count_profile(seqs)


def running_composition(seqs: DataFrame, k: int) -> DataFrame:
    """k-mer counts of all sequences so far."""
    return kmers(seqs, k).groupBy("kmer").agg(F.count("*").alias("n"))


def peptide_sites(chunks: DataFrame, peptide: str) -> DataFrame:
    """id, pos of sites that read the peptide on either strand, over a stream of chunks (id, seq) in order.

    The state of an id is its last 3 * len(peptide) - 1 symbols and its offset, whatever has passed.
    """
    if not peptide:
        raise ValueError("an empty peptide has no sites")
    keep = 3 * len(peptide) - 1
    from ..functions.sites import find_sites

    def run(key, tables: Iterator[pd.DataFrame], state):
        tail, start = state.get if state.exists else ("", 0)
        found: list[int] = []
        for table in tables:
            for part in table["seq"]:
                text = tail + (part or "")
                found += [start + p for p in find_sites(text, peptide)]
                cut = max(0, len(text) - keep)
                tail, start = text[cut:], start + cut
        state.update((tail, start))
        yield pd.DataFrame({"id": [key[0]] * len(found), "pos": found}).astype({"pos": "int64"})

    kind = chunks.schema["id"].dataType.simpleString()
    return chunks.select("id", "seq").groupBy("id").applyInPandasWithState(
        run, f"id {kind}, pos long", "tail string, start long", "append", "NoTimeout"
    )


__all__ = ["peptide_sites", "running_composition", "running_profile"]
