"""Token counts at every prefix, by dynamic programming over prefixes.

A merge tokenizer's last token of a prefix fixes all tokens before it: if t is the
last token of a prefix, the rest are the tokens of the prefix without t.  So one pass
keeps, for each prefix, its last token and its count.  The last token of prefix i is
the only piece t ending at i for which (last token of the prefix i - len(t), t) is a
pair that the merges themselves leave as it is.  count[i] = count[i - len(t)] + 1.

No piece of the vocabulary holds a space mark after another character (checked when it
is loaded), so merges never cross into a run of spaces from its left.  A text is thus
cut before each such run and its parts are counted alone; the counts of parts met
before come from a dictionary of bounded size in each Python worker.

Stored form: ``prefix_steps``, one signed byte for each code point, the change of the
count there; running sums give the count at every prefix (a step can be negative:
a longer prefix may merge better).  A character outside the vocabulary counts its
UTF-8 bytes, as the library's byte fallback does.

Cases: null and empty texts have no steps and count 0; a null doc_id is kept; the whole
text counts, however long; the library drops nothing and the count is of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, per_worker, table

MARK = "▁"
MEMO = 1_500_000
LIMIT = 4096


class PrefixCounter:
    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(lib.get_piece_size()):
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)):
                self.rank[lib.id_to_piece(i)] = -lib.get_score(i)
                self.ids[lib.id_to_piece(i)] = i
        self.encode = lib.encode
        self.alone = not any("\n" in p for p in self.rank) and len(lib.encode("\n")) == 2
        crossing = [p for p in self.rank if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces hold a space mark after other characters: {crossing[:3]}")
        self.longest = max(map(len, self.rank), default=1)
        # the last three characters (two, of shorter pieces) leave few lengths of pieces
        ends: dict[str, set[int]] = {}
        for p in self.rank:
            ends.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {k: tuple(sorted((n for n in v if n > 1), reverse=True)) for k, v in ends.items()}
        # no merge joins two characters that stand side by side in no piece
        self.inside = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.stays: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merges themselves on a short text: best score first, leftmost on ties."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best = min(
                ((rank[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in rank), default=None
            )
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _pair_stays(self, a: str, b: str) -> bool:
        got = self.stays.get((a, b))
        if got is None:
            # a line feed is in no piece, so what stands before it changes nothing
            ids = self.encode("\n" + (a + b).replace(MARK, " ")) if self.alone else None
            got = ids[-2:] == [self.ids[a], self.ids[b]] and len(ids) == 4 if ids else self.merged(a + b) == [a, b]
            if len(self.stays) >= MEMO:
                self.stays.clear()
            self.stays[a, b] = got
        return got

    def _steps(self, part: str) -> bytes:
        """The change of the count at each character of a part, cut where no merge can reach across."""
        inside, runs, out, start = self.inside, self.runs, [], 0
        for k in range(1, len(part) + 1):
            if part[k - 1 : k + 1] not in inside:
                run = part[start:k]
                got = runs.get(run)
                if got is None:
                    if len(runs) >= MEMO:
                        runs.clear()
                    got = runs[run] = self._dynamic(run)
                out.append(got)
                start = k
        return out[0] if len(out) == 1 else b"".join(out)

    def _dynamic(self, part: str) -> bytes:
        rank, lengths, stays = self.rank, self.lengths, self.stays
        last, count, out = [""], [0], bytearray()
        none = ()
        for i in range(1, len(part) + 1):
            token, n = "", 0
            for suffix in (part[i - 3 : i], part[i - 2 : i]) if i > 2 else (part[:i],):
                for size in lengths.get(suffix, none):
                    if size > i:
                        continue
                    t = part[i - size : i]
                    if t in rank:
                        before = last[i - size]
                        if before:
                            ok = stays.get((before, t))
                            if not (self._pair_stays(before, t) if ok is None else ok):
                                continue
                        token, n = t, count[i - size] + 1
                        break
                if n:
                    break
            if not n:
                token = part[i - 1]
                n = count[i - 1] + (1 if token in rank else len(token.encode()))
            last.append(token)
            # a step of a byte: the largest gain is 4, a loss is bounded by the longest piece
            out.append(n - count[i - 1] & 0xFF)
            count.append(n)
        return bytes(out)

    def _part(self, word: str, run: int) -> bytes:
        """Steps of a word and the marks before it."""
        key = word if run == 1 else " " * (run - 1) + word
        got = self.parts.get(key)
        if got is None:
            if len(self.parts) >= MEMO:
                self.parts.clear()
            got = self.parts[key] = self._steps(MARK * run + word)
        return got

    def steps(self, text: str) -> bytes:
        """prefix_steps of a text without the mark that the library puts before it.

        That mark, one token alone, joins the first character's step.
        """
        if not text:
            return b""
        parts, out = self.parts, []
        text = text.replace(MARK, " ")
        words = text.split(" ")
        if "" not in words:
            out = list(map(parts.get, words))
            if None in out:
                for k, got in enumerate(out):
                    if got is None:
                        out[k] = self._part(words[k], 1)
            out[0] = _joined(out[0])
            return b"".join(out)
        run = 1  # marks before the word, the library's own first
        first = True
        for w in words:
            if not w:
                run += 1
                continue
            got = self._part(w, run)
            if first:
                # the library's mark is not a character of the text
                got = _joined(got)
                first = False
            out.append(got)
            run = 1
        if run > 1:  # spaces at the end
            got = self._steps(MARK * (run - 1))
            out.append(_joined(got) if first else got)
        return b"".join(out)


def _joined(steps: bytes) -> bytes:
    return bytes([(steps[0] + steps[1]) & 0xFF]) + steps[2:]


_counter = per_worker(PrefixCounter)


def prefix_counts(steps: bytes) -> np.ndarray:
    """Count at every prefix (of 1, 2, ... code points) from the stored steps."""
    return np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)


def fits(steps: bytes, budget: int) -> int:
    """Code points of the longest prefix whose count, and that of no longer prefix, is over the budget."""
    ok = np.flatnonzero(prefix_counts(steps) <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def count_prefixes(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefix_steps of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column(1).to_pylist()
                steps = [counter.steps(t or "") for t in texts]
                sizes = [len((t or "").encode()) for t in texts]
                counts = [int(np.frombuffer(s, np.int8).sum(dtype=np.int64)) for s in steps]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(steps, pa.binary())],
                    ["doc_id", "n_bytes", "n_tokens", "prefix_steps"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, prefix_steps binary"
    )


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    got = count_prefixes(documents(table(spark, sf_dir, "documents")), path("piece_bpe_32k.model"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
