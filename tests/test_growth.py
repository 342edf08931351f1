"""What keeps memory and time of a task in proportion: partitions that grow in number, rows handled whole."""

import random

import pytest

from seqframe.functions import spectrum as P
from seqframe.operators import distance, peptide, profile, stages


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def spectra(spark):
    r = random.Random(1)
    return spark.createDataFrame([(r.randrange(40), r.randrange(50)) for _ in range(600)], "spec_id long, mass int")


@pytest.mark.parametrize("name", ["convolution", "modal_difference", "common_counts"])
def test_spectra_are_dealt_over_more_tasks_as_they_grow(spectra, monkeypatch, name):
    f = getattr(distance, name)
    want = sorted(map(str, f(spectra, spectra.where("mass % 3 > 0")).collect()))
    monkeypatch.setattr(stages, "ROWS", 20)
    got = f(spectra, spectra.where("mass % 3 > 0"))
    assert got.rdd.getNumPartitions() >= 30
    assert sorted(map(str, got.collect())) == want


def test_frequent_masses_by_more_tasks(spectra, monkeypatch):
    want = sorted(map(str, peptide.frequent_masses(spectra, 3, 5, 40).collect()))
    monkeypatch.setattr(stages, "ROWS", 20)
    got = peptide.frequent_masses(spectra, 3, 5, 40)
    assert got.rdd.getNumPartitions() == 30
    assert sorted(map(str, got.collect())) == want


def test_nearest_by_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(stages, "ROWS", 10)
    r = random.Random(2)
    left, right = [(i, r.uniform(-5, 120)) for i in range(300)], [round(r.uniform(0, 100), 1) for _ in range(200)]
    got = distance.nearest(spark.createDataFrame(left, "key long, x double"), spark.createDataFrame([(v,) for v in right], "value double"))
    assert got.rdd.getNumPartitions() == 50
    assert {row["key"]: row["nearest"] for row in got.collect()} == {k: min(right, key=lambda v: (abs(v - x), -v)) for k, x in left}


def test_most_probable_windows_are_compared_in_their_row(spark, seqs):
    p = spark.createDataFrame([(0, 0.2, 0.4, 0.3, 0.1), (1, 0.2, 0.3, 0.3, 0.2), (2, 0.3, 0.1, 0.5, 0.1)], "pos int, a double, c double, t double, g double")
    got = profile.most_probable(seqs("ACCTGTTTACT", "ac", "ccTcct", "GGéCCT"), p, 3)
    assert {r["id"]: r["kmer"] for r in got.collect()} == {0: "CCT", 2: "ccT", 3: "CCT"}
    assert "Generate" not in _plan(got)


def test_spectra_of_a_batch_are_made_side_by_side(spark):
    rows = spark.createDataFrame([(i, "GPAKNQEL"[: i % 9]) for i in range(200)], "id long, p string").select("id", P.integer_masses("p").alias("masses"))
    got = peptide.common_counts(rows)
    assert "MapInArrow" in _plan(got)
    want = rows.select("id", P.common_count(P.linear_spectrum("masses"), P.cyclic_spectrum("masses")).alias("n"))
    assert {r["id"]: (r["n"], r["consistent"]) for r in got.collect()} == {r["id"]: (r["n"], True) for r in want.collect()}
