"""Column expressions over peptides, residue masses and spectra (arrays)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..alphabet import INTEGER_MASS, MASS_SYMBOL, MONO_MASS, WATER_MONO
from .seq import col, let, symbols


def _map(values: dict, kind: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v).cast(kind))])


def integer_masses(peptide) -> Column:
    """Integer mass of each residue; null for a letter that is no residue."""
    table = _map(INTEGER_MASS, "int")
    return F.transform(symbols(peptide), lambda x: F.try_element_at(table, x))


def mono_masses(peptide) -> Column:
    table = _map(MONO_MASS, "double")
    return F.transform(symbols(peptide), lambda x: F.try_element_at(table, x))


def from_masses(masses) -> Column:
    """struct(peptide, ok): I for I or L, K for K or Q, ``-`` and not ok for other masses."""
    table = F.create_map(*[F.lit(x) for m, a in MASS_SYMBOL.items() for x in (m, a)])
    each = F.transform(col(masses), lambda m: F.coalesce(F.try_element_at(table, m), F.lit("-")))
    return F.struct(F.array_join(each, "").alias("peptide"), (~F.array_contains(each, "-")).alias("ok"))


def weight(peptide) -> Column:
    """Monoisotopic weight with one water."""
    return F.aggregate(mono_masses(peptide), F.lit(WATER_MONO), lambda a, x: a + x)


def mass_string(masses) -> Column:
    return F.array_join(F.transform(col(masses), lambda m: m.cast("string")), "-")


def _zero(masses: Column, kind: str) -> Column:
    return F.array(F.lit(0).cast(kind))


def prefix_sums(masses, kind: str = "int") -> Column:
    """0 and the running sums: one more than there are masses."""
    m = col(masses)
    return F.aggregate(m, _zero(m, kind), lambda a, x: F.concat(a, F.array((F.element_at(a, -1) + x).cast(kind))))


def prefix_spectrum(masses, kind: str = "int") -> Column:
    """Running sums, as many as masses."""
    return F.slice(prefix_sums(masses, kind), F.lit(2), F.size(col(masses)))


def ideal_spectrum(masses) -> Column:
    """Sorted prefix masses from 0 and suffix masses from the whole: twice as many as residues."""

    def both(p: Column) -> Column:
        head = F.slice(p, F.lit(1), F.size(p) - 1)
        return F.array_sort(F.concat(head, F.transform(head, lambda x: F.element_at(p, -1) - x)))

    return let(prefix_sums(masses), both)


def linear_spectrum(masses, kind: str = "int") -> Column:
    """Sorted masses of 0 and of every run of residues."""

    def runs(p: Column) -> Column:
        each = F.transform(p, lambda x, i: F.transform(F.slice(p, i + 2, F.size(p) - i - 1), lambda y: y - x))
        return F.array_sort(F.concat(F.array(F.lit(0).cast(kind)), F.flatten(each)))

    return let(prefix_sums(masses, kind), runs)


def cyclic_spectrum(masses, kind: str = "int") -> Column:
    """Sorted masses of 0, every proper run around the ring, and the whole."""
    m = col(masses)

    def runs(v: Column) -> Column:
        n, p = v["n"], v["p"]
        each = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: let(F.element_at(p, i), lambda x: F.transform(F.slice(p, i + 1, n - 1), lambda y: y - x)),
        )
        return F.array_sort(F.concat(F.array(F.lit(0).cast(kind)), F.flatten(each), F.array(F.element_at(p, n + 1))))

    ring = F.struct(F.size(m).alias("n"), prefix_sums(F.concat(m, m), kind).alias("p"))
    return F.when(F.size(m) > 0, let(ring, runs)).otherwise(_zero(m, kind))


def quantize(masses, scale: float) -> Column:
    """Nearest integer of mass * scale, halves up."""
    return F.transform(col(masses), lambda m: F.floor(m * scale + 0.5).cast("long"))


def _numbered(values: Column) -> Column:
    """Whole numbers made distinct: each with its place among its equals, as one number."""
    rank = lambda s: F.transform(s, lambda x, i: x.cast("long") * (1 << 24) + i - F.array_position(s, x))
    return let(F.array_sort(values), rank)


def common_count(a, b) -> Column:
    """Size of the multiset intersection of two arrays of whole numbers."""
    return F.size(F.array_intersect(_numbered(col(a)), _numbered(col(b))))


def consistent(a, b) -> Column:
    """Every value of a is in b at least as often."""
    return F.size(F.array_except(_numbered(col(a)), _numbered(col(b)))) == 0


def parse_floats(texts) -> Column:
    """Every string as a double; null when one cannot be read."""
    each = F.transform(col(texts), lambda t: t.try_cast("double"))
    return F.when(~F.exists(each, lambda x: x.isNull()), each)


def sub_peptides_linear(n) -> Column:
    """Runs of a linear peptide of n residues, the empty one included."""
    n = col(n).cast("long")
    return F.floor(n * (n + 1) / 2).cast("long") + 1


def sub_peptides_cyclic(n) -> Column:
    n = col(n).cast("long")
    return n * (n - 1)
