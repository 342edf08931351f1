"""Symbols, codes and tables of nucleic acids and peptides.

Bases are always taken in the order A, C, T, G (bits 1 and 2 of their ASCII codes count 0, 1, 2, 3
in that order), in dense arrays and for ties.
"""

from __future__ import annotations

BASES = "ACTG"
AMINO = "ACDEFGHIKLMNPQRSTVWY"
GAP = "-"
STOP = "*"
DNA_START, RNA_START = "ATG", "AUG"

# IUPAC complements, integer and monoisotopic residue masses, water, the
# standard genetic code, and two substitution matrices (lower triangles).
IUPAC = "GTACRYSWKMDHBVNgtacryswkmdhbvn"
IUPAC_COMPLEMENT = "CATGYRSWMKHDVBNcatgyrswmkhdvbn"
INTEGER_MASS = {
    "A": 71, "C": 103, "D": 115, "E": 129, "F": 147, "G": 57, "H": 137, "I": 113, "K": 128, "L": 113,
    "M": 131, "N": 114, "P": 97, "Q": 128, "R": 156, "S": 87, "T": 101, "V": 99, "W": 186, "Y": 163,
}
MONO_MASS = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891,
    "I": 113.08406, "K": 128.09496, "L": 113.08406, "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858,
    "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}
WATER_MONO = 18.01056
WATER_AVERAGE = 18.01528
PROTON = 1.007
#: The standard code, codons in order T, C, A, G of each place.
_STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
_BLOSUM62 = """A R N D C Q E G H I L K M F P S T W Y V
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4"""
_PAM250 = """A C D E F G H I K L M N P Q R S T V W Y
2
-2 12
0 -5 4
0 -5 3 4
-3 -4 -6 -5 9
1 -3 1 0 -5 5
-1 -3 1 1 -2 -2 6
-1 -2 -2 -2 1 -3 -2 5
-1 -5 0 0 -5 -2 0 -2 5
-2 -6 -4 -3 2 -4 -2 2 -3 6
-1 -5 -3 -2 0 -3 -2 2 0 4 6
0 -4 2 1 -3 0 2 -2 1 -3 -2 2
1 -3 -1 -1 -5 0 0 -2 -1 -3 -2 0 6
0 -5 2 2 -5 -1 3 -2 1 -2 -1 1 0 4
-2 -4 -1 -1 -4 -3 2 -2 3 -3 0 0 0 1 6
1 0 0 0 -3 1 -1 -1 0 -3 -2 1 1 -1 0 2
1 -2 0 0 -3 0 -1 0 0 -2 -1 0 0 -1 -1 1 3
0 -2 -2 -2 -1 -1 -2 4 -2 2 2 -2 -1 -2 -2 -1 0 4
-6 -8 -7 -7 0 -7 -3 -5 -3 -2 -4 -4 -6 -5 2 -2 -5 -6 17
-3 0 -4 -4 7 -5 0 -1 -4 -1 -2 -2 -5 -4 -4 -3 -3 -2 0 10"""


def codon_table() -> str:
    """Residue of each codon by codon index (order A, C, T, G of each place)."""
    old = {a + b + c: _STANDARD[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    return "".join(old[a + b + c] for a in BASES for b in BASES for c in BASES)


def matrix(text: str) -> dict[tuple[str, str], int]:
    """Scores of both orders of each pair, from an alphabet line and a lower triangle or a full square."""
    head, *lines = [x.split() for x in text.strip().splitlines()]
    out: dict[tuple[str, str], int] = {}
    for i, line in enumerate(lines):
        if line and line[0] == head[i]:
            line = line[1:]
        for j, x in enumerate(line):
            out[head[i], head[j]] = int(x)
            out.setdefault((head[j], head[i]), int(x))
    return out


BLOSUM62 = matrix(_BLOSUM62)
PAM250 = matrix(_PAM250)
CODONS = codon_table()
#: The lowest letter of each integer mass: I of I and L, K of K and Q.
MASS_SYMBOL = {m: min(a for a in AMINO if INTEGER_MASS[a] == m) for m in sorted(set(INTEGER_MASS.values()))}
MASSES18 = sorted(MASS_SYMBOL)
