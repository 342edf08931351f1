"""FASTA files as a table, in batch and as a stream.

``read`` splits files into records with Spark's own text reader (any store it knows, large
files split over many tasks, many small ones in one task); ``stream`` does the same for files as they arrive, with Spark's
own record of the files it has seen, whatever their names.  ``register`` adds the format name ``fasta`` for a batch reader with
dense record numbers, one task a file.  Columns: record_no, header (with its mark), id, descr, seq.

Lines are trimmed, blank ones skipped.  Data before the first header is an error in strict
mode and skipped in lenient mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.seq import fasta_description, fasta_id

SCHEMA = "record_no bigint, header string, id string, descr string, seq string"


def parse(lines: Iterator[str], strict: bool = True) -> Iterator[tuple[int, str, str, str, str]]:
    number, header, parts = 0, None, []

    def record():
        name, _, text = header[1:].partition(" ")
        return number, header, name, text, "".join(parts)

    for line in lines:
        line = line.strip()
        if not line:
            continue
        if line.startswith(">"):
            if header is not None:
                yield record()
                number += 1
            header, parts = line, []
        elif header is not None:
            parts.append(line)
        elif strict:
            raise ValueError("No header")
    if header is not None:
        yield record()


def _first_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to rows (piece, file, at) a number, ascending in each task, and ``head``: whether a row is the first of its file.

    A task reads its blocks one after another.
    """
    from pyspark import TaskContext

    block, number = None, TaskContext.get().partitionId() << 33
    for b in batches:
        heads = []
        for file, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            heads.append(at == 0 and (file, at) != block)
            block = (file, at)
        numbers = pa.array(range(number, number + len(heads)), pa.int64())
        number += len(heads)
        yield pa.RecordBatch.from_arrays([numbers, b.column(0), pa.array(heads, pa.bool_())], ["record_no", "p", "head"])


def _records(raw: DataFrame, strict: bool) -> DataFrame:
    """Records of the pieces between marks that begin a line; the reader takes the separator away, so only the
    first piece of a file keeps its mark."""
    piece = raw.select(F.regexp_replace("value", "\r", "").alias("p"), "_metadata.file_path", "_metadata.file_block_start")
    piece = piece.mapInArrow(_first_pieces, "record_no bigint, p string, head boolean")
    blank = F.trim(F.regexp_replace("p", "\n", "")) == ""
    head = F.col("head")
    bare = F.lit(None).cast("string")
    if strict:
        bare = F.raise_error(F.lit("No header")).cast("string")
    body = F.when(~head, F.concat(F.lit(">"), "p")).when(F.startswith(F.regexp_replace("p", r"^\s+", ""), F.lit(">")), F.regexp_replace("p", r"^\s+", "")).otherwise(bare)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    got = piece.where(~(head & blank)).select("record_no", lines.alias("l")).where("l is not null")
    header = F.element_at("l", 1)
    seq = F.array_join(F.slice("l", F.lit(2), F.size("l")), "")
    return got.select("record_no", header.alias("header"), fasta_id(header).alias("id"), fasta_description(header).alias("descr"), seq.alias("seq"))


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All records; the text reader cuts files at the marks, so one large file feeds many tasks.

    record_no ascends within a file but is not dense.  In strict mode a file that does not
    begin with a mark is an error.
    """
    return _records(spark.read.option("lineSep", "\n>").text(path), strict)


def stream(spark: SparkSession, path: str, strict: bool = True, files_per_trigger: int | None = None) -> DataFrame:
    """The records of the files of a folder as they arrive, read by the executors; each file once, in whatever order names sort.

    record_no tells records of one trigger apart.
    """
    reader = spark.readStream.option("lineSep", "\n>")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _records(reader.text(path), strict)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastaReader(DataSourceReader):
    """One task a file; paths of any file system that pyarrow knows."""

    def __init__(self, options: dict):
        self.path, self.strict = options.get("path", ""), options.get("mode", "strict") == "strict"

    def partitions(self):
        return [_Part(p) for p in _files(self.path)]

    def read(self, partition):
        system, path = _system(partition.path)
        with system.open_input_stream(path) as f:
            yield from parse(_lines(f), self.strict)


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)`` over files all workers see."""

    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastaReader(self.options)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def _lines(f) -> Iterator[str]:
    """The lines of a binary stream, a block at a time."""
    rest = b""
    while block := f.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            yield line.decode()
    yield rest.decode()


def _files(path: str) -> list[str]:
    """A file, the files of a folder (hidden ones and marks of finished jobs aside), or those that match a pattern in the last part of the path."""
    from fnmatch import fnmatch

    from pyarrow import fs

    system, inner = _system(path)
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [path]
    folder, _, pattern = (inner, "", "*") if info.type == fs.FileType.Directory else inner.rpartition("/")
    found = [i for i in system.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True)) if i.type == fs.FileType.File]
    return sorted(scheme + i.path for i in found if fnmatch(i.base_name, pattern) and not i.base_name.startswith(("_", ".")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def write(seqs: DataFrame, path: str, width: int = 70) -> None:
    """FASTA text files of (header, seq); lines of ``width`` symbols."""
    folded = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    seqs.select(F.concat("header", F.lit("\n"), folded).alias("value")).write.text(path)
