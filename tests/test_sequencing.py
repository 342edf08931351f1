"""Peptide sequencing: whole peptides, and searches against their definitions."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.alphabet import INTEGER_MASS, MONO_MASS
from seqframe.functions import sequencing
from seqframe.functions import spectrum as P
from seqframe.operators import peptide
from seqframe.plans import REGISTRY, Tables

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


class FewParts(Tables):
    @property
    def peptides(self):
        return super().peptides.where("id <= 3")


@pytest.mark.parametrize("name", ["cyclic_sequencing", "leaderboard"])
def test_whole_peptides_are_sequenced(spark, name):
    """All 32 residues, found again in every rotation and direction."""
    t = FewParts(spark, SF)
    want = {r["id"]: [INTEGER_MASS[a] for a in r["seq"]] for r in t.peptides.collect()}
    got = {(r["spec_id"], tuple(r["masses"])) for r in REGISTRY[name][0](t).collect()}
    assert want
    for k, m in want.items():
        for x in (m, m[::-1]):
            assert {(k, tuple(x[i:] + x[:i])) for i in range(32)} <= got


def test_float_sequencing_reads_whole_peptides(spark):
    """The best score is no less than that of the peptide itself, of which all 994 masses are near."""
    rows = REGISTRY["float_sequencing"][0](FewParts(spark, SF)).collect()
    assert {r["spec_id"] for r in rows} == {0, 1, 2, 3}
    assert all(len(r["peptide"]) >= 31 and r["score"] >= 994 for r in rows)


def test_experimental_sequencing_reads_whole_peptides(spark):
    t = FewParts(spark, SF)
    want = {r["id"]: sum(INTEGER_MASS[a] for a in r["seq"]) for r in t.peptides.collect()}
    rows = REGISTRY["experimental_sequencing"][0](t).collect()
    assert all(sum(r["masses"]) == want[r["spec_id"]] for r in rows)


def _common(a, b):
    return sum(min(a.count(x), b.count(x)) for x in set(a))


def test_leaderboard_without_cuts_is_exhaustive():
    letters = np.array([57, 71, 99])
    spectrum = sequencing.cyclic(np.array([[57, 71, 99, 57]]))[0]
    spectrum = np.sort(np.append(spectrum[spectrum != 128], [60, 128]))
    whole = int(spectrum.max())
    rings = [x for n in range(1, 5) for x in itertools.product(letters.tolist(), repeat=n) if sum(x) == whole]
    score = {x: _common(sequencing.cyclic(np.array([x]))[0].tolist(), spectrum.tolist()) for x in rings}
    got, found = sequencing.leaderboard(spectrum, letters, 10**6, 1)
    assert {tuple(x.tolist()) for x in found} == {x for x in rings if score[x] == max(score.values())}
    assert set(got.tolist()) == {max(score.values())}


def test_near_is_the_plain_comparison():
    random = np.random.default_rng(1)
    spectrum = np.sort(random.uniform(0, 2000, 300))
    near = sequencing.Near(spectrum, 0.3)
    v = np.concatenate([random.uniform(0, 2050, 20000), spectrum + 0.3, spectrum - 0.3, np.nextafter(spectrum + 0.3, 9e9)])
    v = v[v >= 0]
    assert (near(v) == (np.abs(spectrum[None, :] - v[:, None]) <= 0.3).any(axis=1)).all()


def test_spectra_given_as_rows_or_arrays(spark):
    rows = spark.createDataFrame([(7, "GPAK"), (8, "NQEL")], "id long, p string").select("id", P.integer_masses("p").alias("masses"))
    arrays = peptide.theoretical_spectra(rows, True).withColumnRenamed("id", "spec_id")
    as_rows = arrays.select("spec_id", F.explode("spectrum").alias("mass"))
    got = [sorted(map(str, peptide.theoretical_sequences(x).collect())) for x in (arrays, as_rows)]
    assert got[0] == got[1] and len(got[0]) == 16


def test_spectra_of_odd_lists_are_those_of_the_expressions(spark):
    lists = [[1, 2, 4], [], [9], [7, 7, 7, 1], None, [5, None, 3]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, masses array<int>")
    for ring, column in ((False, P.linear_spectrum), (True, P.cyclic_spectrum)):
        want = {r["id"]: r["s"] for r in rows.where("id < 4").select("id", column("masses").alias("s")).collect()}
        got = {r["id"]: r["spectrum"] for r in peptide.theoretical_spectra(rows, ring).collect()}
        assert {k: got[k] for k in want} == want
        assert got[4] == [0] and got[5] == [0, 5] + [None] * (len(got[5]) - 2)


def test_masses_of_any_kind_find_their_peptide():
    letters = [a for a in sorted(MONO_MASS) if a != "L"]
    masses = np.array([MONO_MASS[a] for a in letters])
    p = np.array([letters.index(a) for a in "GASP"])
    score, found = sequencing.float_leaderboard(sequencing.cyclic(masses[p][None])[0], masses, 20, 1, 0.3, 20)
    assert "AGPS" in {"".join(letters[i] for i in x) for x in found} and set(score.tolist()) == {14}
