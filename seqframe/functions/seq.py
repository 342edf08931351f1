"""Column expressions over one sequence, all of built-in functions.

Positions are 0-based in every result.  A null argument gives null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..alphabet import BASES, CODONS, DNA_START, IUPAC, IUPAC_COMPLEMENT, RNA_START

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(s: Column | str) -> Column:
    return F.col(s) if isinstance(s, str) else s


def let(value, body) -> Column:
    """body(x) with x bound to the value, which is then worked out once and not at each use in a lambda."""
    return F.get(F.transform(F.array(col(value)), body), F.lit(0))


class Text:
    """A text bound in a lambda.  As bytes a place is reached at once; as a string Spark walks to it from the start."""

    def __init__(self, x: Column, as_bytes: bool):
        self.x, self.as_bytes = x, as_bytes

    @property
    def length(self) -> Column:
        return F.length(self.x)

    def sub(self, i, n) -> Column:
        """n symbols from the 1-based place i."""
        got = F.substring(self.x, i, F.lit(n) if isinstance(n, int) else n)
        return got.cast("string") if self.as_bytes else got

    def at(self, i) -> Column:
        return self.sub(i, 1)

    def starts(self, k) -> Column:
        """1-based starts of all windows of k symbols; an empty array when there are none."""
        n = self.length - k + 1
        return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def read(body, *texts) -> Column:
    """body of a Text for each of the strings, worked out once; ASCII ones are read as bytes, so that a lambda over
    all places takes time in proportion to the length."""
    names = [f"t{k}" for k in range(len(texts))]

    def choose(v: Column) -> Column:
        ascii_only, raw = F.lit(True), []
        for n in names:
            ascii_only = ascii_only & (F.octet_length(v[n]) == F.length(v[n]))
            raw.append(v[n].cast("binary").alias(n))
        fast = let(F.struct(*raw), lambda b: body(*[Text(b[n], True) for n in names]))
        return F.when(ascii_only, fast).otherwise(body(*[Text(v[n], False) for n in names]))

    return let(F.struct(*[col(t).alias(n) for t, n in zip(texts, names, strict=True)]), choose)


def to_lower(s) -> Column:
    """ASCII letters only; everything else as it is."""
    return F.translate(col(s), _UPPER, _LOWER)


def to_upper(s) -> Column:
    return F.translate(col(s), _LOWER, _UPPER)


def reverse(s) -> Column:
    return F.reverse(col(s))


def transcribe(s) -> Column:
    return F.translate(col(s), "Tt", "Uu")


def complement(s) -> Column:
    """IUPAC complement of each symbol, case kept, other symbols kept."""
    return F.translate(col(s), IUPAC, IUPAC_COMPLEMENT)


def reverse_complement(s) -> Column:
    return F.reverse(complement(s))


def complement8(s) -> Column:
    """Complement of plain DNA: A, C, T, G of either case."""
    return F.translate(col(s), "ACTGactg", "TGACtgac")


def reverse_complement8(s) -> Column:
    return F.reverse(complement8(s))


def skew(b) -> Column:
    """1 of G, -1 of C, else 0."""
    return F.when(to_upper(b) == "G", 1).when(to_upper(b) == "C", -1).otherwise(0)


def count_of(s, symbols: str) -> Column:
    """How many symbols of s are among ``symbols``."""
    s = col(s)
    return (F.length(s) - F.length(F.translate(s, symbols, ""))).cast("long")


def base_counts(s) -> dict[str, Column]:
    """Counts of A, C, T (or U) and G of either case."""
    return {"a": count_of(s, "Aa"), "c": count_of(s, "Cc"), "t": count_of(s, "TtUu"), "g": count_of(s, "Gg")}


def ieee_div(x: Column, y: Column) -> Column:
    """x / y of doubles as IEEE 754 has it: 0 / 0 is NaN, x / 0 an infinity."""
    x, y = x.cast("double"), y.cast("double")
    return (
        F.when(y != 0, x / F.when(y != 0, y))
        .when(x > 0, F.lit(float("inf")))
        .when(x < 0, F.lit(float("-inf")))
        .when(x.isNotNull() & y.isNotNull(), F.lit(float("nan")))
    )


def gc_content(s) -> Column:
    """(G + C) / (A + C + T + G); NaN without bases."""
    n = base_counts(s)
    return ieee_div(n["g"] + n["c"], n["a"] + n["c"] + n["t"] + n["g"])


def gc_content8(s) -> Column:
    """(G + C) / length; NaN of an empty sequence."""
    return ieee_div(count_of(s, "GCgc"), F.length(col(s)))


def starts(s, k: Column | int) -> Column:
    """1-based starts of all windows of k symbols; an empty array when there are none."""
    n = F.length(col(s)) - (F.lit(k) if isinstance(k, int) else k) + 1
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def windows(s, k: int) -> Column:
    """Array of struct(pos, kmer) of all k-mers."""
    return read(lambda t: F.transform(t.starts(k), lambda i: F.struct((i - 1).alias("pos"), t.sub(i, k).alias("kmer"))), s)


def symbols(s) -> Column:
    """Array of the symbols."""
    return read(lambda t: F.transform(t.starts(1), t.at), s)


def all_index(s, motif: Column | str, fold: bool = False) -> Column:
    """Positions of all occurrences of a motif, overlapping ones too; an empty motif has none.

    A plain str names the motif itself.  ``fold`` compares without regard to ASCII case.
    """
    s, m = col(s), F.lit(motif) if isinstance(motif, str) else motif
    if fold:
        s, m = to_upper(s), to_upper(m)

    def hits(x: Text, y: Text) -> Column:
        # bytes are compared as they are
        same = lambda i: F.substring(x.x, i, y.length) == y.x
        return F.transform(F.filter(x.starts(y.length), same), lambda i: i - 1)

    return F.when(F.length(m) > 0, read(hits, s, m)).otherwise(F.array().cast("array<int>"))


def all_count(s, motif: str, fold: bool = False) -> Column:
    """Number of occurrences, overlapping ones too."""
    if not motif:
        return F.lit(0)
    s = to_upper(s) if fold else col(s)
    word = motif.upper() if fold else motif
    return F.regexp_count(s, F.lit("(?=" + re.escape(word) + ")"))


def first_index(s, motif: Column | str) -> Column:
    """Position of the first occurrence, or -1."""
    return F.locate(motif, col(s)) - 1 if isinstance(motif, str) else F.instr(col(s), motif) - 1


def hamming(s, t, fold: bool = False) -> Column:
    """Number of places that differ; an error for unequal lengths."""
    s, t = (to_upper(s), to_upper(t)) if fold else (col(s), col(t))
    n = read(lambda x, y: F.size(F.filter(x.starts(1), lambda i: x.at(i) != y.at(i))), s, t)
    return F.when(F.length(s) == F.length(t), n).otherwise(F.raise_error(F.lit("sequences of unequal length")).cast("int"))


def p_distance(s, t, fold: bool = False) -> Column:
    return ieee_div(hamming(s, t, fold), F.length(col(s)))


#: A motif given as a plain str of up to so many symbols is compared place by place without an array of places.
UNROLLED = 64


def window_hamming(s: Text, motif: Text | str, i: Column) -> Column:
    """Differences of the motif and the window of s from the 1-based place i."""
    if isinstance(motif, str):
        out = F.lit(0)
        for j, c in enumerate(motif):
            out = out + (s.at(i + j) != c).cast("int")
        return out
    return F.size(F.filter(F.sequence(F.lit(1), motif.length), lambda j: s.at(i + j - 1) != motif.at(j)))


def _with_motif(s, motif: Column | str, body) -> Column:
    """body(Text, motif, length of the motif) with the motif as a str or as a Text."""
    if isinstance(motif, str) and 0 < len(motif) <= UNROLLED:
        return read(lambda x: body(x, motif, F.lit(len(motif))), s)
    return read(lambda x, m: body(x, m, m.length), s, F.lit(motif) if isinstance(motif, str) else motif)


def hamming_all_index(s, motif: str, d: int) -> Column:
    """Positions of the windows that differ from the motif in at most d places."""

    def near(x: Text, m, n: Column) -> Column:
        return F.transform(F.filter(x.starts(n), lambda i: window_hamming(x, m, i) <= d), lambda i: i - 1)

    return _with_motif(s, motif, near)


def motif_hamming(s, motif: Column | str) -> Column:
    """Least differences of any window, whatever the case; the motif's length when s is shorter."""

    def least(x: Text, m, n: Column) -> Column:
        return F.array_min(F.transform(x.starts(n), lambda i: window_hamming(x, m, i)))

    m = to_upper(F.lit(motif)) if isinstance(motif, str) else to_upper(motif)
    folded = motif.translate(str.maketrans(_LOWER, _UPPER)) if isinstance(motif, str) else m
    return F.coalesce(_with_motif(to_upper(s), folded, least), F.length(m))


def nearest_kmers(s, motif: str, fold: bool = False) -> Column:
    """Windows with the least differences from the motif, in order, repeated ones too."""
    s, motif = (to_upper(s), motif.translate(str.maketrans(_LOWER, _UPPER))) if fold else (col(s), motif)

    def near(x: Text, m, n: Column) -> Column:
        at = F.transform(x.starts(n), lambda i: F.struct(window_hamming(x, m, i).alias("d"), i.alias("i")))
        least = lambda y: F.struct(y.alias("at"), F.array_min(F.transform(y, lambda z: z["d"])).alias("least"))
        pick = lambda v: F.transform(F.filter(v["at"], lambda z: z["d"] == v["least"]), lambda z: x.sub(z["i"], n))
        return let(let(at, least), pick)

    return _with_motif(s, motif, near)


def splice(s, introns: list[str]) -> Column:
    """The sequence without the introns: one pass, leftmost first, earlier introns before later ones."""
    return F.regexp_replace(col(s), "|".join(map(re.escape, introns)), "")


def palindromes(s, least: int, most: int) -> Column:
    """Array of struct(pos, len) of even-length reverse palindromes, centre by centre, inner first."""
    low, high = max(2, least + least % 2) // 2, most // 2

    def all_(x: Text, y: Text) -> Column:
        # y is the strand that stands opposite, read from the other end: place c there is place n - c here
        n = x.length

        def at(c: Column) -> Column:
            # c symbols stand left of the centre
            reach = F.least(c, n - c, F.lit(high))
            halves = F.when(reach >= low, F.sequence(F.lit(low), reach)).otherwise(F.array().cast("array<int>"))
            fits = F.filter(halves, lambda h: F.substring(x.x, c + 1, h) == F.substring(y.x, n - c + 1, h))
            return F.transform(fits, lambda h: F.struct((c - h).alias("pos"), (2 * h).alias("len")))

        # the two symbols at the centre match first
        centres = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        inner = F.filter(centres, lambda c: F.substring(x.x, c + 1, F.lit(1)) == F.substring(y.x, n - c + 1, F.lit(1)))
        return F.flatten(F.transform(inner, at))

    return let(to_upper(s), lambda u: read(all_, u, reverse_complement8(u)))


def codon_index(codon: Column) -> Column:
    """0 to 63 by the places of the codon, order A, C, T (or U), G."""
    code = [F.ascii(F.substring(codon, i, 1)).bitwiseAND(F.lit(6)) for i in (1, 2, 3)]
    return code[0] * 8 + code[1] * 2 + F.shiftright(code[2], 1)


def translate_codon(codon: Column, of_complement: bool = False) -> Column:
    codon = complement8(codon) if of_complement else codon
    return F.substring(F.lit(CODONS), codon_index(codon) + 1, F.lit(1))


def is_start_codon(codon: Column) -> Column:
    return to_upper(codon).isin(DNA_START, RNA_START)


def residues(s, frame: int = 0) -> Column:
    """All codons from the frame on as one string, stops as ``*``; an incomplete codon is left out."""

    def codons(t: Text) -> Column:
        n = F.floor((t.length - frame) / 3).cast("int")
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda k: translate_codon(t.sub(k * 3 + frame + 1, 3)))
        return F.when(n >= 1, F.array_join(each, "")).otherwise(F.when(t.length.isNotNull(), F.lit("")))

    return read(codons, s)


def translate(s) -> Column:
    """struct(peptide, stop): up to the first stop codon or the end."""
    both = lambda r: F.struct(F.split_part(r, F.lit("*"), F.lit(1)).alias("peptide"), (F.instr(r, "*") > 0).alias("stop"))
    return let(residues(s), both)


def number(kmer) -> Column:
    """A k-mer as a base-4 number, digits A, C, T, G."""
    kmer = col(kmer)
    digit = lambda i: F.shiftright(F.ascii(F.substring(kmer, i, F.lit(1))), 1).bitwiseAND(F.lit(3))
    return F.aggregate(starts(kmer, 1), F.lit(0).cast("long"), lambda a, i: a * 4 + digit(i))


def kmer_of(n: Column, k: int) -> Column:
    """The k-mer of a base-4 number, in capitals."""
    digit = lambda j: F.substring(F.lit(BASES), F.floor(n / F.pow(F.lit(4), j)).cast("long").bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(k - 1), F.lit(0)), digit), "")


def sort_key(s) -> Column:
    """Orders by length, then A < C < T < G with the small letter before the capital at each place."""
    s = col(s)
    return F.struct(F.length(s).alias("n"), F.translate(s, "aAcCtTgG", "01234567").alias("s"))


def fasta_id(header) -> Column:
    """The header without its mark up to the first space."""
    return F.substring_index(F.substring(col(header), F.lit(2), F.length(col(header))), " ", 1)


def fasta_description(header) -> Column:
    h = col(header)
    at = F.instr(h, " ")
    return F.when(at > 0, F.substring(h, at + 1, F.length(h))).otherwise(F.lit(""))


def titv(s, t) -> Column:
    """Transitions over transversions of two sequences; symbols that are no bases do not count."""

    def pairs(x: Text, y: Text) -> Column:
        return F.transform(x.starts(1), lambda i: F.concat(x.at(i), y.at(i)))

    def ratio(p: Column) -> Column:
        ti = F.size(F.filter(p, lambda x: x.isin("AG", "GA", "CT", "TC")))
        tv = F.size(F.filter(p, lambda x: x.isin("AC", "CA", "AT", "TA", "GC", "CG", "GT", "TG")))
        return ieee_div(ti, tv)

    return let(read(pairs, to_upper(s), to_upper(t)), ratio)


def linear_gap(s, t, score, penalty: int) -> Column:
    """Score of an alignment: each gap column costs the penalty."""

    def total(x: Text, y: Text) -> Column:
        def place(i: Column) -> Column:
            a, b = x.at(i), y.at(i)
            return F.when((a == "-") | (b == "-"), F.lit(-penalty)).otherwise(score(a, b))

        return F.aggregate(x.starts(1), F.lit(0), lambda acc, i: acc + place(i))

    return read(total, s, t)


def constant_gap(s, t, score, penalty: int) -> Column:
    """Score of an alignment: each run of gaps on one side costs the penalty once."""

    def total(x: Text, y: Text) -> Column:
        def state(i: Column) -> Column:
            return F.when(x.at(i) == "-", 1).when(y.at(i) == "-", 2).otherwise(0)

        def place(i: Column) -> Column:
            now, before = state(i), F.when(i > 1, state(i - 1)).otherwise(0)
            return F.when(now == 0, score(x.at(i), y.at(i))).when(now != before, F.lit(-penalty)).otherwise(F.lit(0))

        return F.aggregate(x.starts(1), F.lit(0), lambda acc, i: acc + place(i))

    return read(total, s, t)


def matrix_score(scores: dict[tuple[str, str], int]):
    """A scoring function of two symbol columns from a table; unknown symbols are an error."""
    table = F.create_map(*[x for (a, b), v in scores.items() for x in (F.lit(a + b), F.lit(v))])

    def score(x: Column, y: Column) -> Column:
        return F.coalesce(F.element_at(table, F.concat(x, y)), F.raise_error(F.lit("symbol outside the matrix")).cast("int"))

    return score


def match_score(match: int, mismatch: int):
    return lambda x, y: F.when(x == y, match).otherwise(mismatch)
