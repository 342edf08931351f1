"""Texts handled many at once against one at a time."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqframe.alphabet import BLOSUM62
from seqframe.functions import batch
from seqframe.functions import seq as S
from seqframe.functions.suffix import codes, suffix_array
from seqframe.operators import align, neighbours, search


def _texts(n, alphabet, low, high, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(low, high))) for _ in range(n)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("alphabet", ["A", "ACGT", "aé\U0001f600"])
def test_suffix_arrays_of_many_texts(alphabet):
    texts = [t + "$" for t in _texts(50, alphabet, 0, 30)] + ["$$", "aaa$"]
    joined = codes("".join(texts))
    got = np.split(batch.suffix_arrays(joined, np.array([len(t) for t in texts])), np.cumsum([len(t) for t in texts])[:-1])
    assert [x.tolist() for x in got] == [suffix_array(codes(t)).tolist() for t in texts]


@pytest.mark.parametrize("pattern", ["CA", "A", "AAA", "é", "Q"])
def test_index_search_of_many_texts_at_once(spark, seqs, pattern, monkeypatch):
    monkeypatch.setattr(batch, "SYMBOLS", 64)
    s = seqs(*_texts(60, "ACé", 0, 25), "", "CACA$", None)
    got = search.index_search(s, pattern)
    assert _plan(got).count("MapInArrow") == 1
    want = search.search_index(search.full_text_index(s), pattern)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_peptide_sites_against_reading_frames(spark, seqs):
    s = seqs(*_texts(80, "ACGTacgt", 0, 60), *_texts(20, "ACGTN-é", 0, 60), "", None)
    for peptide in ("L", "LS", "*"):
        hit = search.frames(s).select("id", "strand", "frame", "n", F.explode(S.all_index("residues", peptide)).alias("at"))
        p = F.col("at") * 3 + F.col("frame")
        want = hit.select("id", F.when(F.col("strand") == 1, p).otherwise(F.col("n") - p - 3 * len(peptide)).alias("pos"), "strand")
        assert sorted(map(tuple, search.peptide_sites(s, peptide).collect())) == sorted(map(tuple, want.collect()))
        found = search.peptide_sites(s, peptide, distinct=True)
        assert "Generate" not in _plan(found)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.select("id", "pos").distinct().collect()))


@pytest.mark.parametrize("mode", align.MODES)
def test_scores_of_many_pairs(spark, mode):
    a, b = _texts(40, "ACDEFGHIKL", 0, 9), _texts(40, "ACDEFGHIKL", 0, 9, 6)
    rows = spark.createDataFrame([*zip(a, b, strict=True), (None, "A"), ("A", None)], "s string, t string")
    scores = align.Scores(BLOSUM62)
    got = [r[0] for r in rows.select(align.score("s", "t", mode, scores, 5)).collect()]
    assert got == [align.align(x, y, mode, scores, 5)[0] for x, y in zip(a, b, strict=True)] + [None, None]
    assert rows.select(align.score("s", "t", mode, indel=2)).first()[0] == align.align(a[0], b[0], mode, align.Scores(), 2)[0]


def test_median_motifs_by_the_definition(spark):
    import itertools

    texts = [(i // 2, t) for i, t in enumerate(_texts(30, "ACGTNacgt", 0, 12))]
    rows = spark.createDataFrame(texts, "id long, seq string")
    k, total = 3, {}
    held = {}
    for i, t in texts:
        held.setdefault(i, set()).update(t.upper()[j : j + k] for j in range(len(t) - k + 1))
    short = sum(len(t) < k for _, t in texts)
    for m in map("".join, itertools.product("ACGT", repeat=k)):
        total[m] = short * k + sum(min(sum(x != y for x, y in zip(m, w, strict=True)) for w in ws) for ws in held.values() if ws)
    got = neighbours.median_motifs(rows, k)
    assert "CartesianProduct" not in _plan(got) and "Generate" not in _plan(got)
    assert {tuple(r) for r in got.collect()} == {(m, d) for m, d in total.items() if d == min(total.values())}
