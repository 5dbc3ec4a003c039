"""Operator 1: token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents. Ids are cut into blocks of BLOCK values; a block stores its minimum, the width in
bits that covers a chosen percentile of the values above the minimum, the low bits of all values packed at that width, and an
exception list (position, high bits) for the rest. An index of block starts and a table of documents follow.

File layout, little-endian:
  4 bytes  magic
  blocks   min u32, width u8, pad u8, exceptions u16, packed values, exception positions u16[], exception high parts u32[]
  index    u64 offset of each block, then u64 offset of the end
  docs     i64 doc_id[], u32 n_ids[], u8 has_id[]
  footer   u64 index offset, u64 documents, u64 ids, u32 blocks, u32 block size, 4 bytes magic

Documents are dealt to files by range of doc_id and sorted inside a file, so the files in order give ascending doc_id order
(null doc_ids first; equal doc_ids in any order). A retried task writes its file anew under another name and renames it.
Nulls and empty texts give no ids (only the end id); an empty table gives no files. Other columns are not written.
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changeloom.llm.common import columns, in_worker, work_dir, worker_cache
from changeloom.llm.word_table import WordTable

MAGIC = b"PFB1"
BLOCK = 1024
#: Share of the values of a block that its width covers; the others become exceptions.
COVERED = 0.97
_HEAD, _FOOT = struct.Struct("<IBBH"), struct.Struct("<QQQII4s")


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits needed for each unsigned 32-bit value."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, low `width` bits each, as rows of bytes (least significant bit first)."""
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def unpack(data: np.ndarray, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros((len(data), n), np.uint32)
    bits = np.unpackbits(data, axis=1, count=n * width, bitorder="little").reshape(len(data), n, width)
    out = np.zeros((len(data), n), np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of ids (unsigned 32-bit); the last may be short."""
    full = len(ids) // BLOCK
    parts = [ids[: full * BLOCK].reshape(full, BLOCK)] + ([ids[full * BLOCK :].reshape(1, -1)] if len(ids) > full * BLOCK else [])
    out: list[bytes] = []
    for rows in parts:
        low = rows.min(axis=1) if len(rows) else np.zeros(0, np.uint32)
        above = rows - low[:, None]
        width = np.sort(_bits(above), axis=1)[:, max(0, int(np.ceil(COVERED * rows.shape[1])) - 1)] if len(rows) else low
        made: list[bytes] = [b""] * len(rows)
        for w in np.unique(width):
            pick = np.flatnonzero(width == w)
            packed = pack(above[pick], int(w)) if w else np.zeros((len(pick), 0), np.uint8)
            high = (above[pick].astype(np.uint64) >> np.uint64(w)).astype(np.uint32)
            for k, row in enumerate(pick):
                at = np.flatnonzero(high[k])
                made[row] = _HEAD.pack(int(low[row]), int(w), 0, len(at)) + packed[k].tobytes() + at.astype("<u2").tobytes() + high[k][at].astype("<u4").tobytes()
        out += made
    return out


def decode_block(data: memoryview, n: int) -> np.ndarray:
    low, width, _, odd = _HEAD.unpack_from(data)
    size = (n * width + 7) // 8
    out = unpack(np.frombuffer(data, np.uint8, size, _HEAD.size).reshape(1, -1), width, n)[0]
    at = np.frombuffer(data, "<u2", odd, _HEAD.size + size)
    out[at] |= np.frombuffer(data, "<u4", odd, _HEAD.size + size + 2 * odd) << np.uint32(width)
    return out + np.uint32(low)


class Writer:
    """Writes one file, keeping less than a block of ids and the documents' sizes in memory."""

    def __init__(self, sink: io.RawIOBase):
        self.sink, self.rest, self.at = sink, np.zeros(0, np.uint32), len(MAGIC)
        self.starts, self.docs, self.sizes, self.known = [], [], [], []
        sink.write(MAGIC)

    def _emit(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids):
            self.starts.append(self.at)
            self.at += len(block)
            self.sink.write(block)

    def add(self, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.array([d or 0 for d in doc_ids], "<i8"))
        self.known.append(np.array([d is not None for d in doc_ids], np.uint8))
        self.sizes.append(sizes.astype("<u4"))
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        whole = len(ids) // BLOCK * BLOCK
        self._emit(ids[:whole])
        self.rest = ids[whole:].copy()

    def close(self) -> tuple[int, int]:
        """Finish the file: documents and ids written."""
        self._emit(self.rest)
        index = self.at
        docs, ids = sum(map(len, self.docs)), int(sum(int(s.sum()) for s in self.sizes))
        self.sink.write(np.array([*self.starts, index], "<u8").tobytes())
        for part in (self.docs, self.sizes, self.known):
            self.sink.write(b"".join(x.tobytes() for x in part))
        self.sink.write(_FOOT.pack(index, docs, ids, len(self.starts), BLOCK, MAGIC))
        return docs, ids


def read_file(data: memoryview, group: int = 2048) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) in file order. Decodes `group` blocks at a time."""
    index, docs, ids, blocks, size, magic = _FOOT.unpack_from(data, len(data) - _FOOT.size)
    if magic != MAGIC or bytes(data[:4]) != MAGIC:
        raise ValueError("not a token block file")
    starts = np.frombuffer(data, "<u8", blocks + 1, index)
    at = index + 8 * (blocks + 1)
    names = np.frombuffer(data, "<i8", docs, at)
    sizes = np.frombuffer(data, "<u4", docs, at + 8 * docs).astype(np.int64)
    known = np.frombuffer(data, np.uint8, docs, at + 12 * docs)
    have, block = np.zeros(0, np.uint32), 0
    for name, n, ok in zip(names.tolist(), sizes.tolist(), known.tolist(), strict=True):
        if len(have) < n:
            parts, total = [have], len(have)
            while total < n or (len(parts) <= group and block < blocks):
                parts.append(decode_block(data[int(starts[block]) : int(starts[block + 1])], min(size, ids - block * size)))
                total += len(parts[-1])
                block += 1
            have = np.concatenate(parts)
        yield (name if ok else None), have[:n]
        have = have[n:]


def filesystem(path: str):
    """A pyarrow file system and the path on it, of a folder shared by all executors (file:, hdfs:, s3: ...)."""
    from pyarrow import fs

    if "://" not in path and path.startswith("/") or path.startswith("file:"):
        return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path)


_tables: dict[str, WordTable] = worker_cache()


def write(df: DataFrame, path: str, end_id: int, folder: str | None = None, n_files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode the texts, append end_id to each, write the files; (file, documents, ids) of each file in order of doc_id.

    What comes back to the driver is three numbers a file; n_files defaults to one for every 20,000 documents or two a core."""
    spark = df.sparkSession
    folder = folder or work_dir(spark, "token-blocks")
    if n_files is None:
        n_files = max(2 * spark.sparkContext.defaultParallelism, df.select(id_col).count() // 20_000)
    docs = df.select(id_col, text_col).repartitionByRange(n_files, id_col).sortWithinPartitions(id_col)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        files, base = filesystem(folder)
        name = f"part-{task.partitionId():08d}.pfb"
        sink = writer = None
        if path not in _tables:
            _tables[path] = WordTable(path)
        for ids_of, text in columns(batches, id_col, text_col):
            if writer is None:
                files.create_dir(base, recursive=True)
                sink = files.open_output_stream(trial := f"{base}/.{name}.{task.taskAttemptId()}")
                writer = Writer(sink)
            ids, sizes = _tables[path].encode(text)
            ends = np.cumsum(sizes)
            writer.add(ids_of.to_pylist(), sizes + 1, np.insert(ids, ends, end_id))
        if writer is not None:
            docs_n, ids_n = writer.close()
            sink.close()
            files.move(trial, f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.array([f"{folder}/{name}"]), pa.array([docs_n], pa.int64()), pa.array([ids_n], pa.int64())], names=[f.name for f in schema])

    rows = docs.mapInArrow(run, schema).collect()
    return [(r.file, r.docs, r.ids) for r in sorted(rows, key=lambda r: r.part)]


def read(spark, files: list[tuple[str, int, int]], digest: bool = False) -> DataFrame:
    """Rows of the files: doc_id, start (ids before it in all files), n_tokens, and ids or with digest their ids_crc32."""
    last = T.StructField("ids_crc32", T.LongType()) if digest else T.StructField("ids", T.ArrayType(T.LongType()))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), last])
    base, told = 0, []
    for name, _, n in files:
        told.append((name, base))
        base += n
    if not told:
        return spark.createDataFrame([], schema)

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                store, place = filesystem(name)
                with store.open_input_file(place) as f:
                    data = memoryview(f.read())
                rows: list[tuple] = []
                for doc, ids in read_file(data):
                    rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.tolist()))
                    at += len(ids)
                    if len(rows) >= 1000:
                        yield _batch(rows, schema)
                        rows = []
                if rows:
                    yield _batch(rows, schema)

    listing = spark.sparkContext.parallelize(told, len(told)).toDF("file string, base long")
    return listing.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64()] * 3 + [pa.int64() if isinstance(schema[3].dataType, T.LongType) else pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.name for f in schema])
