"""Exact token ids of a public byte-level BPE vocabulary, each distinct word of a batch encoded once.

The library splits a text by a fixed pattern before any merge, and no piece of that
split reaches across a space that follows a character other than white space.  So a
text falls apart at such spaces, and the ids of a word with the space before it depend on it alone.
Arrow finds the distinct words of a batch; their ids come from one run over the words put in a row, cut at
the words' ends by the byte lengths of the tokens; numpy then lays them out in the order of the texts.

The run over the row merges by the ranks of the library's own file (``tiktoken``, which does no more than that).
That the two agree rests on three things that are looked up in the file: byte-level split with the library's pattern, no
normalizer, and ids in the order of the merges; where one does not hold, and for texts that hold an added token's
string, the library itself encodes each text.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

_IRREGULAR = regex.compile(r"\s ")
_ASCII_RUNS = [a + " " for a in " \t\n\v\f\r"]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest come after it."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _merger(path: str, added: list[str]) -> tiktoken.Encoding | None:
    """The same merges by rank; None if the file is not of the kind that ranks alone describe."""
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    split, model = told.get("pre_tokenizer") or {}, told["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not told.get("normalizer")
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = [model["vocab"][m] for m in made]
    if any(a >= b for a, b in zip(order, order[1:], strict=False)):
        return None
    byte = {c: b for b, c in enumerate(byte_letters())}
    ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in added}
    if len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.merger = _merger(path, self.special)
        self.size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u4" if self.size > 1 << 16 else "<u2")
        if self.merger:
            self.length = np.zeros(self.size, np.int64)
            for k in range(self.merger.n_vocab):
                self.length[k] = len(self.merger.decode_single_token_bytes(k))

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _row(self, text: str) -> np.ndarray:
        return self.merger.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)

    def _is_whole(self, text: str) -> bool:
        """Whether spaces do not cut the text, so that it is encoded as one piece."""
        return any(x in text for x in _ASCII_RUNS) or not (text.isascii() or not _IRREGULAR.search(text))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with a space before it, one after another, and their numbers."""
        sizes = np.asarray(pc.binary_length(words), np.int64)
        # white space at a word's end would run into the next space
        alone = np.flatnonzero((sizes == 0) | (np.asarray(pc.binary_length(pc.utf8_rtrim_whitespace(words))) < sizes))
        rest = np.ones(len(words), bool)
        rest[alone] = False
        row = words if not len(alone) else words.filter(pa.array(rest))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), " ")[0].as_py()
        ids = self._row(" " + joined) if len(row) else np.zeros(0, self.dtype)
        ends, cuts = np.cumsum(self.length[ids]), np.cumsum(sizes[rest] + 1)
        counts = np.zeros(len(words), np.int64)
        if len(row):
            last = np.minimum(np.searchsorted(ends, cuts), len(ends) - 1)
            if last[-1] != len(ids) - 1 or not np.array_equal(ends[last], cuts):
                raise AssertionError("a token reaches across two words")
            counts[rest] = np.diff(last + 1, prepend=0)
        if not len(alone):
            return ids, counts
        extra = [self._row(" " + w) for w in words.take(pa.array(alone)).to_pylist()]
        before = np.concatenate([[0], np.cumsum(counts)])[alone]
        counts[alone] = [len(x) for x in extra]
        at = np.repeat(before, counts[alone])
        return np.insert(ids, at, np.concatenate(extra)), counts

    def batch(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, ``end`` after each, and their numbers."""
        tail = np.array([] if end is None else [end], self.dtype)
        if self.merger is None:
            each = [np.concatenate([self._library(t), tail]) for t in texts]
            return np.concatenate([*each, tail[:0]]), np.array([len(x) for x in each], np.int64)
        heads, cut = [], []
        for t in texts:
            special = any(s in t for s in self.special)
            if special or self._is_whole(t):
                heads.append(self._library(t) if special else self._row(t))
                cut.append("")
            else:
                heads.append(self._row(t[: t.find(" ")] if " " in t else t))
                cut.append(t)
        words = pc.split_pattern(pa.array(cut, pa.string()), " ")
        offsets = np.asarray(words.offsets, np.int64)
        told = words.flatten().dictionary_encode()
        ids, counts = self._words(told.dictionary)
        # units: the distinct words, the heads of the texts, the end
        counts = np.concatenate([counts, [len(h) for h in heads], [len(tail)]])
        ids = np.concatenate([ids, *heads, tail])
        starts = np.cumsum(counts) - counts
        n_words, n = len(told.dictionary), len(texts)
        unit = np.full(offsets[-1] + n, n_words + n)
        unit[np.arange(offsets[-1]) + np.repeat(np.arange(n), np.diff(offsets))] = np.asarray(told.indices)
        unit[offsets[:-1] + np.arange(n)] = n_words + np.arange(n)
        sizes = counts[unit]
        before = np.cumsum(sizes) - sizes
        out = ids[np.repeat(starts[unit] - before, sizes) + np.arange(before[-1] + sizes[-1])] if n else ids[:0]
        ends = np.concatenate([[0], np.cumsum(sizes)])[offsets[1:] + np.arange(1, n + 1)]
        return out, np.diff(ends, prepend=0)

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian 16-bit numbers (32-bit for a vocabulary over 65,536)."""
        return self.batch([text])[0].tobytes()
