"""Peptide sites in plain DNA, for code that sees one text at a time."""

from __future__ import annotations

from ..alphabet import BASES, CODONS

_OPPOSITE = str.maketrans("ACTG", "TGAC")


def find_sites(dna: str, peptide: str) -> list[int]:
    """Ascending places where either strand reads the peptide, each once."""
    text = dna.upper()
    want = 3 * len(peptide)

    def read(s: str) -> str:
        return "".join(CODONS[16 * BASES.index(s[i]) + 4 * BASES.index(s[i + 1]) + BASES.index(s[i + 2])] for i in range(0, want, 3))

    out = []
    for p in range(len(text) - want + 1):
        site = text[p : p + want]
        if read(site) == peptide or read(site.translate(_OPPOSITE)[::-1]) == peptide:
            out.append(p)
    return out
