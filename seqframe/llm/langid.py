"""Language identification by prediction by partial matching (PPM).

One variable-order context tree over all 256 bytes for each language gives the exact code
length of a text: escape method C with exclusion, orders MAX_ORDER down to 0, then an
even share for bytes not seen.  The statistics are frozen after training, so the code
length of a byte depends on the byte and its MAX_ORDER predecessors alone (a text starts
after spaces).

A tree is kept as sorted arrays: for each order the (context, byte) pairs seen with their
counts, and for each context its total and kinds, and those that its shorter context keeps when
the context's own bytes are excluded.  Bytes seen after a context were seen after
the shorter one too, so these four numbers give every escape and every exclusion.  The
pairs of the highest order that any language has seen have their costs in all languages worked out on
the driver; a worker finds them by a hash and works out the others, each once a slice.

Cases: a null text or one without a letter is ``und`` with score 0; equal code
lengths go to the language first in alphabetical order; with no training rows every
text is ``und``; very long texts are summed in slices of bounded size; columns of other names,
also of those that the result has, change nothing.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, own_name, per_worker, table

MAX_ORDER = 4
#: The training sample: so many documents of a language at most (the lowest by a hash of
#: the id), and so many bytes of each from a hashed offset.
SAMPLE_DOCS = 300
SAMPLE_BYTES = 4000
#: A text is rejected when its best language needs more than this many times the bits a
#: byte that the language's own training text needs on average.
REJECT_RATE = 2.2
_LETTER = re.compile(r"[^\W\d_]")
_SLICE = 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _keys(raw: bytes, order: int, before: bytes = b"") -> np.ndarray:
    """For each byte of ``raw`` the number of its ``order`` predecessors and itself; spaces stand before all."""
    a = np.frombuffer((b" " * order + before)[-order:] + raw if order else raw, np.uint8).astype(np.uint64)
    n = len(raw)
    out = np.zeros(n, np.uint64)
    for k in range(order + 1):
        out = (out << np.uint64(8)) | a[k : k + n]
    return out


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of the asked numbers among the ascending keys, -1 for those that are not there."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)


@dataclass
class Level:
    """One order of a tree: pairs (context and byte in one number) and contexts, both ascending."""

    pairs: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    #: What the context one shorter holds beside the bytes seen here.
    rest_total: np.ndarray
    rest_kinds: np.ndarray


@dataclass
class Tree:
    levels: list[Level]
    kinds: int  # different bytes seen

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each byte after its context, both as one number of the highest order."""
        top, bits = len(self.levels) - 1, np.zeros(len(keys))
        left = np.ones(len(keys), bool)  # not coded yet
        longer = np.full(len(keys), -1)  # the context one longer, whose bytes are excluded
        for k in range(top, -1, -1):
            level = self.levels[k]
            own = keys & np.uint64((1 << 8 * (k + 1)) - 1)
            node, pair = _find(level.contexts, own >> np.uint64(8)), _find(level.pairs, own)
            total, kinds = level.total[node].astype(np.float64), level.kinds[node].astype(np.float64)
            may_come = np.full(len(keys), 256.0)
            if k < top:
                up, cut = self.levels[k + 1], longer >= 0
                may_come -= np.where(cut, kinds - up.rest_kinds[longer], 0)
                total = np.where(cut, up.rest_total[longer], total)
                kinds = np.where(cut, up.rest_kinds[longer], kinds)
            # an order that has seen all bytes that may come needs no escape
            base = np.log2(np.maximum(total + np.where(kinds < may_come, kinds, 0), 1))
            known = left & (node >= 0)
            hit = known & (pair >= 0)
            bits[hit] += (base - np.log2(level.n[pair]))[hit]
            # a context whose bytes are all excluded codes nothing
            missed = known & ~hit & (total > 0)
            bits[missed] += (base - np.log2(np.maximum(kinds, 1)))[missed]
            left &= ~hit
            longer = node
        bits[left] += np.log2(max(1, 256 - self.kinds))
        return bits


def grow(texts: list[bytes], order: int = MAX_ORDER) -> Tree:
    levels: list[Level] = []
    every = [_keys(t, order) for t in texts]
    keys = np.concatenate(every) if every else np.zeros(0, np.uint64)
    for k in range(order + 1):
        pairs, n = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
        contexts, first = np.unique(pairs >> np.uint64(8), return_index=True)
        add = (lambda x, at=first: np.add.reduceat(x, at)) if len(first) else (lambda x: x)
        total, kinds = add(n), add(np.ones(len(n), np.int64))
        if k:
            lower = levels[-1]
            mask = np.uint64((1 << 8 * k) - 1)
            taken = add(lower.n[_find(lower.pairs, pairs & mask)])
            parent = _find(lower.contexts, contexts & np.uint64((1 << 8 * (k - 1)) - 1))
            rest = (lower.total[parent] - taken, lower.kinds[parent] - kinds)
        else:
            rest = (np.zeros_like(total), np.zeros_like(kinds))
        levels.append(Level(pairs, n, contexts, total, kinds, *rest))
    return Tree(levels, len(levels[0].pairs))


@dataclass
class Model:
    """The trees, and the costs of the pairs of the highest order that any of them has seen."""

    langs: tuple[str, ...]
    trees: list[Tree]
    pairs: np.ndarray = field(init=False)
    cells: np.ndarray = field(init=False)  # a row for each pair, a column for each language

    def __post_init__(self):
        own = [t.levels[-1].pairs for t in self.trees]
        self.pairs = np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64)
        self.cells = self.costs(self.pairs)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros((len(keys), len(self.trees)))
        for k, tree in enumerate(self.trees):
            out[:, k] = tree.costs(keys)
        return out

    @property
    def order(self) -> int:
        return len(self.trees[0].levels) - 1


class Coder:
    """Code lengths by a model; pairs of the highest order are found by their hash in tables of slots."""

    def __init__(self, model: Model):
        self.model, self.tables = model, []
        rows = np.arange(len(model.pairs))
        # what a slot cannot hold goes to the next, smaller table
        for salt in (1, 3, 5):
            if not len(rows):
                break
            wide = max(4, int(4 * len(rows) - 1).bit_length())
            slots = np.full(1 << wide, -1, np.int32)
            at = self._slot(model.pairs[rows], salt, wide)
            slots[at] = rows
            self.tables.append((salt, wide, slots))
            rows = rows[slots[at] != rows]

    @staticmethod
    def _slot(keys: np.ndarray, salt: int, wide: int) -> np.ndarray:
        return (keys * _MULT * np.uint64(salt)) >> np.uint64(64 - wide)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each pair of the highest order, a column for each language."""
        out = np.zeros((len(keys), len(self.model.langs)))
        left = np.arange(len(keys))
        for salt, wide, slots in self.tables:
            row = slots[self._slot(keys[left], salt, wide)]
            hit = self.model.pairs[row] == keys[left]
            out[left[hit]] = self.model.cells[row[hit]]
            left = left[~hit]
        each, back = np.unique(keys[left], return_inverse=True)
        out[left] = self.model.costs(each)[back]
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of whole texts, a row for each and a column for each language."""
        order = self.model.order
        sums = np.zeros((len(texts), len(self.model.langs)))
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def add() -> None:
            nonlocal held, size
            if held:
                first = np.cumsum([0] + [len(keys) for _, keys in held])[:-1]
                got = np.add.reduceat(self.costs(np.concatenate([keys for _, keys in held])), first)
                np.add.at(sums, [k for k, _ in held], got)
            held, size = [], 0

        for k, text in enumerate(texts):
            for at in range(0, len(text), _SLICE):
                held.append((k, _keys(text[at : at + _SLICE], order, text[max(0, at - order) : at])))
                size += len(held[-1][1])
                if size >= _SLICE:
                    add()
        add()
        return sums


def train(samples: dict[str, list[bytes]], order: int = MAX_ORDER) -> Model:
    langs = tuple(sorted(samples))
    return Model(langs, [grow(samples[lang], order) for lang in langs])


def samples_of(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """The bounded training sample: rows with a language outside the held-out fifth."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    cut = F.substring(
        "text",
        (F.pmod(h, F.greatest(F.length("text") - n_bytes, F.lit(0)) + 1) + 1).cast("int"),
        F.lit(n_bytes),
    )
    one = F.struct(h.alias("h"), cut.alias("t"))
    # languages are counted, then rows thinned by a hash to about twice n_docs of each before they meet
    sizes = {r["lang"]: r["count"] for r in ids.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * n_docs / v + 0.0001)))])
    thin = ids.where(F.pmod(h, F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    got = thin.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(one)), 1, n_docs)["t"].alias("ts")).collect()
    return {r["lang"]: [t.encode() for t in r["ts"]] for r in got}


_coder = per_worker(lambda blob: Coder(pickle.loads(blob)), most=1)


class Scorer:
    """Adds columns lang_pred, score and bits_per_byte to any table with a text column."""

    def __init__(self, spark: SparkSession, model: Model):
        self.model = model
        # at most as many pairs of each order as the bounded training sample has bytes
        self.shipped = spark.sparkContext.broadcast(pickle.dumps(model))

    def column(self, text: Column) -> Column:
        shipped = self.shipped

        @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
        def predict(texts: pd.Series) -> pd.DataFrame:
            coder = _coder(shipped.value)
            model = coder.model
            raw = [t.encode("utf-8", "surrogatepass") if t and model.langs and _LETTER.search(t) else b"" for t in texts]
            rows = []
            for t, b in zip(raw, coder.bits(raw) if model.langs else raw, strict=True):
                if not t:
                    rows.append(("und", 0.0, 0.0))
                    continue
                k = int(b.argmin())
                # the odds are tempered by the length, so that long texts do not all score 1
                odds = np.exp2(-(b - b[k]) / (1 + len(t) / 4))
                rows.append((model.langs[k], float(1 / odds.sum()), float(b[k] / len(t))))
            return pd.DataFrame(rows, columns=["lang_pred", "score", "bits_per_byte"])

        return predict(text)


def fit(docs: DataFrame) -> Scorer:
    return Scorer(docs.sparkSession, train(samples_of(docs)))


def usual_rate(model: Model) -> dict[str, float]:
    """Bits a byte that each language's tree needs for its own training statistics."""
    out = {}
    for lang, tree in zip(model.langs, model.trees, strict=True):
        top = tree.levels[-1]
        out[lang] = float((tree.costs(top.pairs) * top.n).sum() / max(1, top.n.sum()))
    return out


def keep_known(docs: DataFrame, scorer: Scorer, rate: float = REJECT_RATE) -> DataFrame:
    """Rows of ``docs`` (all columns) in a learned language: not ``und``, and no worse
    compressed than ``rate`` times that language's usual rate."""
    usual = usual_rate(scorer.model)
    if not usual:
        return docs.where(F.lit(False))
    most = F.create_map(*[x for k, v in usual.items() for x in (F.lit(k), F.lit(v * rate))])
    got = scorer.column(F.col("text"))
    name = own_name(docs, "__langid")
    kept = docs.withColumn(name, got).where(
        (F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.bits_per_byte") <= most[F.col(f"{name}.lang_pred")])
    )
    return kept.drop(name)


def op10_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = fit(docs)
    got = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scorer.column(F.col("text")).alias("p"))
    return got.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits_per_byte")
