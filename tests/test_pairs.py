"""All-pairs distances in blocks against one pair at a time."""

import itertools
import random
from collections import Counter

import pytest

from seqframe.functions import pairs
from seqframe.functions import seq as S
from seqframe.operators import distance, kmers


def _texts(n, alphabet, low, high, seed=3):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(low, high))) for _ in range(n)]


def _l1(a, b, k):
    x, y = (Counter(t[i : i + k] for i in range(len(t) - k + 1)) for t in (a, b))
    return sum(abs(x[m] - y[m]) for m in x | y)


@pytest.mark.parametrize("k", [1, 3, 9])
@pytest.mark.parametrize("alphabet", ["ACGT", "abé\U0001f600z"])
def test_composition_kernel(k, alphabet):
    a, b = _texts(30, alphabet, 0, 40), _texts(20, alphabet, 0, 40, 5)
    got = pairs.composition(k)(a, b)
    assert [[_l1(x, y, k) for y in b] for x in a] == got.tolist()


def test_hamming_kernel():
    a, b = _texts(9, "ACé", 300, 300), _texts(7, "ACé", 300, 300, 8)
    assert pairs.hamming(a, b).tolist() == [[sum(p != q for p, q in zip(x, y)) for y in b] for x in a]
    with pytest.raises(ValueError):
        pairs.hamming(["A"], ["AC"])


def test_blocks_hold_every_pair_once(spark, monkeypatch):
    """Blocks far smaller than the table; no shuffle or join of single pairs is planned."""
    monkeypatch.setattr(distance, "BLOCK", 7)
    texts = _texts(60, "ACGTN", 12, 12)
    rows = spark.createDataFrame([(i * 3 - 50, s) for i, s in enumerate(texts)], "id long, seq string")
    want = {(r["i"], r["j"]): r["d"] for r in distance.matrix(rows, S.titv).collect()}
    got = distance.block_matrix(rows, pairs.titv, "double").collect()
    assert len(got) == len(want) == 60 * 59 // 2
    assert {(r["i"], r["j"]): repr(r["d"]) for r in got} == {k: repr(d) for k, d in want.items()}
    d = kmers.composition_distance(rows, 3)
    assert {(r["i"], r["j"]): r["d"] for r in d.collect()} == {(i * 3 - 50, j * 3 - 50): _l1(texts[i], texts[j], 3) for i, j in itertools.combinations(range(60), 2)}
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
