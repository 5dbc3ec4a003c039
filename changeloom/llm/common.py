"""Helpers shared by the training-data operators: shared work folder, table access, batching, word hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handled at a time inside a Python worker, in characters. Bounds the memory of a batch, not the work.
SUB_BATCH_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local[...] session may lack that setting; it then gets a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("changeloom.local.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="changeloom-")
        spark.conf.set("changeloom.local.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._changeloom_path = path
    return out


#: Rows of a table (or documents it tells of) for each file, where that leaves a task to every core.
FILE_ROWS = 10_000


def few_parts(df: DataFrame, rows: int) -> DataFrame:
    """df in as many parts as so many rows need, or as there are cores. To be written: a file for each of the shuffle's partitions costs
    an executor memory and, on a local folder, two processes a file (for its mode), whose start counts its memory twice."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def discard(*frames: DataFrame) -> None:
    """Delete materialized frames that no later step reads."""
    for df in frames:
        if path := getattr(df, "_changeloom_path", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Tables that a Python worker keeps from task to task; they go when it starts to work for another operator.
WORKER_CACHES: list[dict] = []
_at_work: list[str] = [""]


def worker_cache() -> dict:
    WORKER_CACHES.append({})
    return WORKER_CACHES[-1]


def in_worker(run: Callable) -> Callable:
    """For functions given to mapInArrow: a worker keeps the tables of one operator only, and gives memory back after each task."""

    @functools.wraps(run)
    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _at_work[0] != run.__module__:
            _at_work[0] = run.__module__
            for cache in WORKER_CACHES:
                cache.clear()
        yield from run(batches)
        gc.collect(0)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            pass

    return wrapped


def row_key(id_col: str, text_col: str) -> Column:
    """16 bytes that name a row by its id and text, in the order of the ids (null without one). Rows with equal keys hold equal ids and texts."""
    digest = F.substring(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, 16)
    return F.unhex(F.concat(F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), digest))


def id_of(key: str) -> Column:
    """The id in a row_key."""
    return F.conv(F.hex(F.substring(F.col(key), 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(2**63)))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups, and the number of each row's group, from batches sorted by the keys (numbers without nulls)."""
    held: list[pa.RecordBatch] = []

    def numbered(rows: pa.Table) -> np.ndarray:
        values = [rows[k].to_numpy() for k in keys]
        return np.cumsum(np.append(False, np.logical_or.reduce([v[1:] != v[:-1] for v in values]))) if len(rows) else np.zeros(0, np.int64)

    for b in batches:
        if not len(b):
            continue
        rows = pa.Table.from_batches([*held, b])
        group = numbered(rows)
        at = int(np.searchsorted(group, group[-1]))
        if at:
            yield rows.slice(0, at).combine_chunks(), group[:at]
        held = rows.slice(at).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, numbered(rows)


def columns(batches: Iterable[pa.RecordBatch], *names: str, chars: int = SUB_BATCH_CHARS) -> Iterator[list]:
    """Slices of the named columns, as Arrow arrays, each of about so many characters of the last one."""
    for b in batches:
        cols = [b.column(b.schema.get_field_index(n)) for n in names]
        last = cols[-1]
        sizes = np.zeros(len(last), np.int64)
        if pa.types.is_string(last.type) or pa.types.is_large_string(last.type):
            sizes = pc.binary_length(last).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        cut = (np.cumsum(sizes) // chars).astype(np.int64) if len(last) else sizes
        starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(last)]
        for a, z in zip(starts[:-1], starts[1:], strict=True):
            if z > a:
                yield [c.slice(a, z - a) for c in cols]


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start_i, start_i + 1, ... of every run, one run after the other."""
    total = int(lens.sum())
    shift = np.repeat(starts - (np.cumsum(lens) - lens), lens)
    return np.arange(total, dtype=np.int64) + shift


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def coded(lists: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A list<string> array as codes of its values, the distinct values, and the number of values of each row."""
    lens = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    made = lists.flatten().dictionary_encode()
    return made.indices.to_numpy(zero_copy_only=False), made.dictionary, lens


def ascii_words(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text (null: none), A-Z in lower case: codes, distinct words, words per text."""
    lower = pc.ascii_lower(text.fill_null(""))
    codes, words, lens = coded(pc.ascii_split_whitespace(lower))
    empty = pc.index(words, "").as_py() if len(words) else -1
    if empty >= 0:
        keep = codes != empty
        ends = np.concatenate([[0], np.cumsum(lens)])
        lens = np.diff(np.concatenate([[0], np.cumsum(keep)])[ends])
        codes = codes[keep]
    return codes, words, lens


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words.fill_null("").to_numpy(zero_copy_only=False)), np.uint64, len(words))
