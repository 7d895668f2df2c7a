"""Token files in the seekable format of zstandard.

A file is a row of independent frames of a fixed number of ids, each a complete zstandard
frame; a seek table in a skippable frame at the end holds the compressed and the original size of
every frame and a checksum (the low 32 bits of XXH64). Any zstandard reader can decode a file
whole; a reader of some documents reads the table and the frames that hold them. Ids are unsigned
32-bit, little-endian. A Parquet table beside the files, ``index``, says where each document is.

Files hold ascending ranges of document ids. They are written under a temporary name and then moved,
so a task that runs twice or dies leaves no half file.
"""

from __future__ import annotations

import struct
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import quotewright.llm.tokens
from quotewright.llm.store import per_worker
from quotewright.llm.tokens import PartTokenizer

for _module in (__name__, quotewright.llm.tokens.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

FRAME_BYTES = 1 << 18  # of ids in a frame, a multiple of 4
# Fixed values of the published seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER = "<IBI"
FOOTER_BYTES = struct.calcsize(FOOTER)
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
INDEX = "doc_id long, part int, start long, n_tokens long"


class FrameWriter:
    """Writes bytes as frames, and the seek table on close."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.waiting, self.entries, self.written = bytearray(), [], 0

    def write(self, data: bytes) -> None:
        self.waiting += data
        self.written += len(data)
        while len(self.waiting) >= self.frame_bytes:
            self._frame(bytes(self.waiting[:self.frame_bytes]))
            del self.waiting[:self.frame_bytes]

    def _frame(self, data: bytes) -> None:
        from xxhash import xxh64_intdigest

        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxh64_intdigest(data) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.waiting:
            self._frame(bytes(self.waiting))
        table = np.array(self.entries, ENTRY).tobytes()
        footer = struct.pack(FOOTER, len(self.entries), HAS_CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)


class FrameReader:
    """Reads ranges of the original bytes; decompresses the frames that hold them, once in a row."""

    def __init__(self, source):
        import zstandard

        self.source = source
        end = source.size()
        source.seek(end - FOOTER_BYTES)
        frames, flags, magic = struct.unpack(FOOTER, source.read(FOOTER_BYTES))
        if magic != SEEKABLE or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        source.seek(end - FOOTER_BYTES - frames * ENTRY.itemsize)
        self.table = np.frombuffer(source.read(frames * ENTRY.itemsize), ENTRY)
        self.places = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.table["size"], dtype=np.int64)])
        self.decompressor = zstandard.ZstdDecompressor()
        self.at, self.data = -1, b""

    def _frame(self, i: int) -> bytes:
        from xxhash import xxh64_intdigest

        if i != self.at:
            self.source.seek(int(self.places[i]))
            packed = self.source.read(int(self.table["packed"][i]))
            self.data = self.decompressor.decompress(packed, max_output_size=int(self.table["size"][i]))
            if xxh64_intdigest(self.data) & 0xFFFFFFFF != self.table["checksum"][i]:
                raise ValueError(f"frame {i}: wrong checksum")
            self.at = i
        return self.data

    def read(self, start: int, size: int) -> bytes:
        first = int(np.searchsorted(self.starts, start, "right")) - 1
        out, i = [], first
        while size > 0:
            skip = start - int(self.starts[i])
            piece = self._frame(i)[skip:skip + size]
            out.append(piece)
            start, size, i = start + len(piece), size - len(piece), i + 1
        return b"".join(out)


def _file(folder: str, part: int) -> str:
    return f"{folder}/tokens-{part:06d}.zst"


def _write(folder: str, tokenizer_path: str, end_id: int, frame_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        unfinished = f"{root}/unfinished-{uuid.uuid4().hex}"
        tokenizer, end = per_worker(("parts", tokenizer_path), lambda: PartTokenizer(tokenizer_path)), np.array([end_id], "<u4").tobytes()
        writer = stream = None
        for batch in batches:
            ids, starts, counts = batch.column(0), [], []
            if writer is None:
                system.create_dir(root, recursive=True)
                stream = system.open_output_stream(unfinished)
                writer = FrameWriter(stream, frame_bytes)
            for text in batch.column(1):
                data = tokenizer.encode(text.as_py() or "") + end
                starts.append(writer.written // 4)
                counts.append(len(data) // 4)
                writer.write(data)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())],
                ["doc_id", "part", "start", "n_tokens"])
        if writer is not None:
            writer.close()
            stream.close()
            final = _file(root, part)
            if system.get_file_info(final).type == fs.FileType.NotFound:
                system.move(unfinished, final)
            else:  # an earlier attempt at the same rows has finished
                system.delete_file(unfinished)

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 2, frame_bytes: int = FRAME_BYTES) -> None:
    """Writes every document's ids and ``end_id`` to a new ``folder`` that all executors share.

    Documents stand in ascending order of id, NULL ids first, equal ids by text; a NULL text is empty
    and has one id. Texts are shuffled once, by range of id. Other columns are ignored. An empty
    table gives an empty index and no file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    index = ordered.mapInArrow(_write(folder, tokenizer, end_id, frame_bytes), INDEX)
    index.write.parquet(f"{folder}/index")


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        at, reader, source = None, None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n_tokens"))))
            first, ids, size = 0, [], 0
            for i, (part, start, n) in enumerate(rows):
                if part != at:
                    if source is not None:
                        source.close()
                    source = system.open_input_file(_file(root, part))
                    reader, at = FrameReader(source), part
                ids.append(reader.read(4 * start, 4 * n))
                size += 4 * n
                if size > 1 << 22 or i == len(rows) - 1:
                    some = batch.slice(first, len(ids))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("doc_id"), some.column("global_start"), some.column("n_tokens"), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])
                    first, ids, size = i + 1, [], 0

    return read


def read_token_files(spark: SparkSession, folder: str, wanted: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of all documents, or of those whose id is in ``wanted`` (doc_id).

    ``start`` counts the ids of all documents before. Only frames with wanted documents are
    decompressed; a frame whose checksum differs raises an error.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(  # one row per file
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = index if wanted is None else index.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    placed = rows.join(parts, "part").select(
        "doc_id", "part", "start", "n_tokens", (F.col("start") + F.col("_before")).alias("global_start"))
    # A fixed number of partitions: Spark sees the small index, not the files that are read for it.
    return placed.repartition(max(1, parts.count()), "part").sortWithinPartitions("part", "start").mapInArrow(
        _read(folder), "doc_id long, start long, n_tokens long, ids binary")
