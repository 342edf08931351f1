"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code.

Ids are replaced by their rank by frequency over the whole corpus (rank 0: the most
frequent; equal counts in order of id), so the common ones take one byte.  Ranks are
written in 1 to 4 bytes each, low byte first; the byte counts stand in separate
control bytes, two bits a value, four values a byte, so a block decodes by table
lookup without looking at the data bytes.

Files.  ``write`` leaves a Parquet dataset ``frames`` in the shared folder, a row for
each frame: shard (ascending with doc_id), frame (from 0 in each shard), ids before
the frame in its shard, the doc_ids and id counts of its documents, and the two byte
streams ``control`` and ``data``.  The small dataset ``ranks`` maps rank to id.
A frame holds whole documents: FRAME_IDS ids or one longer document.  Parquet is the
container only so that every store and Spark's task commit work; the streams are opaque to it.

Cases: a null text is an empty document (its end id alone); rows that share a
doc_id are separate documents, in any order; a null doc_id sorts first; an empty
table gives empty datasets.
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop_folder, drop_stage, per_worker, shared_dir, stage_table, table

END_ID = 0
FRAME_IDS = 1 << 18
FRAMES = (
    "shard int, frame int, before long, n_ids long, doc_ids array<long>, doc_lens array<long>, control binary, data binary"
)


# ---- the code ------------------------------------------------------------------

#: For each control byte: bytes of its four values.
_SIZES = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.astype(np.uint8).tobytes(), v.view(np.uint8).reshape(-1, 4)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values again: sizes by lookup of the control bytes, then one gather for each byte place."""
    size = _SIZES[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    start = np.cumsum(size, dtype=np.int64) - size
    out = raw[start].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        at = np.flatnonzero(size > k)
        if len(at):
            out[at] |= raw[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ---- writing -------------------------------------------------------------------


def _load(path: str):
    from .vocab import Encoder

    return Encoder(path)


_encoder = per_worker(_load)


#: Texts are encoded together up to so many bytes.
SLICE_BYTES = 1 << 23


def slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose strings have SLICE_BYTES bytes in all, or one row."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield b.slice(at, to - at)
        at = to


TOKENS = "doc_id long, ids binary, wide boolean, counts binary"


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, 16 bits each; 32 for a vocabulary over 65,536), the end id included.

    The last row of a task has no ids but ``counts``: how often each id came in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        total = np.zeros(enc.size, np.int64)
        wide = enc.dtype.itemsize == 4
        for b in batches:
            for part in slices(b, 1):
                ids, sizes = enc.batch([t or "" for t in part.column(1).to_pylist()], END_ID)
                total += np.bincount(ids, minlength=len(total))
                n = part.num_rows
                ends = np.concatenate([[0], np.cumsum(sizes)]) * enc.dtype.itemsize
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])
                columns = [part.column(0), raw.cast(pa.binary()), pa.array(np.full(n, wide)), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "wide", "counts"])
        row = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([wide]), pa.array([total.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(row, ["doc_id", "ids", "wide", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def count_ids(tokens: DataFrame) -> DataFrame:
    """id and n over all documents, from the counts of the tasks; a task sends at most one row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                n = np.frombuffer(raw, np.int64)
                ids = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n[ids], pa.int64())], ["id", "n"])

    told = tokens.select("counts").where(F.col("counts").isNotNull())
    return told.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def frames(tokens: DataFrame, rank_of: np.ndarray) -> DataFrame:
    """Frames in ascending doc_id order; ``rank_of`` has the rank of each id of the vocabulary."""
    spark = tokens.sparkSession
    # its size is that of the vocabulary
    shipped = spark.sparkContext.broadcast(rank_of.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranks, shard = shipped.value, TaskContext.get().partitionId()
        state = {"frame": 0, "before": 0}

        def emit(ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
            values = ranks[np.concatenate(parts)]
            control, data = pack(values)
            row = [shard, state["frame"], state["before"], len(values), ids, [len(p) for p in parts], control, data]
            state["frame"] += 1
            state["before"] += len(values)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["shard", "frame", "before", "n_ids", "doc_ids", "doc_lens", "control", "data"]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        ids, parts, held = [], [], 0
        for b in batches:
            for doc, raw, wide in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                own = _ids(raw, wide)
                if parts and held + len(own) > FRAME_IDS:
                    yield emit(ids, parts)
                    ids, parts, held = [], [], 0
                ids.append(doc)
                parts.append(own)
                held += len(own)
        if parts:
            yield emit(ids, parts)

    ordered = tokens.where(F.col("counts").isNull()).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.select("doc_id", "ids", "wide").mapInArrow(run, FRAMES)


def write(docs: DataFrame, path: str, out: str) -> None:
    """Tokenize every text of (doc_id, text) and write the datasets ``out``/frames and ``out``/ranks."""
    spark = docs.sparkSession
    # ids compress by a fifth, and the files stand beside the shuffle and the frames
    tokens = stage_table(tokenize(docs, path), "tokens", "zstd")
    # at most one row for each id of the vocabulary reaches the driver
    seen = sorted(count_ids(tokens).collect(), key=lambda r: (-r["n"], r["id"]))
    order = np.array([r["id"] for r in seen], np.int64)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    spark.createDataFrame(
        [(k, r["id"], r["n"]) for k, r in enumerate(seen)], "rank long, id long, n long"
    ).coalesce(1).write.parquet(f"{out}/ranks")
    frames(tokens, rank_of).write.option("compression", "uncompressed").parquet(f"{out}/frames")
    drop_stage(tokens)


# ---- reading -------------------------------------------------------------------


def _open(spark: SparkSession, out: str) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    got = spark.read.schema(FRAMES).parquet(f"{out}/frames")
    order = np.array(
        [r["id"] for r in spark.read.schema("rank long, id long, n long").parquet(f"{out}/ranks").orderBy("rank").collect()],
        np.uint32,
    )
    # a row for each shard, that is for each task of the writing job
    sizes = got.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    starts = dict(zip([r["shard"] for r in sizes], itertools.accumulate([0] + [r["n"] for r in sizes]), strict=False))
    return got, order, starts


def read(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (array of int) from the files."""
    return _decode(spark, out, "ids array<long>", lambda own: own.astype(np.int64))


def _decode(spark: SparkSession, out: str, column: str, make) -> DataFrame:
    got, order, starts = _open(spark, out)
    shipped = spark.sparkContext.broadcast((order, starts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, starts = shipped.value
        for b in batches:
            for k in range(b.num_rows):
                shard, before, n, docs, lens, control, data = (b.column(x)[k].as_py() for x in range(7))
                ids = order[unpack(control, data, n)] if n else np.zeros(0, np.uint32)
                ends = np.cumsum(lens)
                each = [make(ids[e - x : e]) for e, x in zip(ends.tolist(), lens, strict=True)]
                first = starts[shard] + before + ends - lens
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(first, pa.int64()), pa.array(lens, pa.int64()), pa.array(each)],
                    ["doc_id", "start", "n_tokens", column.split()[0]],
                )

    columns = got.select("shard", "before", "n_ids", "doc_ids", "doc_lens", "control", "data")
    return columns.mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")


def digest(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    return _decode(spark, out, "ids_crc32 long", lambda own: zlib.crc32(own.astype("<u4").tobytes()))


def op8_streamed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    out = f"{shared_dir(spark)}/seqframe/ids-{uuid.uuid4().hex}"
    write(documents(table(spark, sf_dir, "documents")), path("byte_bpe_50k.json"), out)
    read_back = stage_table(digest(spark, out), "digest")
    drop_folder(spark, out)
    return read_back
