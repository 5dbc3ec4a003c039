"""Operator 10: BPE encoding and decoding through a table of distinct words.

Texts are split into words that encode independently; each distinct word of a batch is encoded once and kept in a bounded
table; ids are joined back to the texts by word position. Decoding looks every id up in a table of pieces.

The word table belongs to a Python worker, not to the cluster: a table of all words of the corpus would have to be joined
to every word position by a shuffle, which writes more than the texts themselves. No row is shuffled here.

Nulls and empty texts give no ids (and decode to the empty string). Other columns pass through untouched; output columns that
clash with input columns replace them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import SUB_BATCH_CHARS, in_worker, worker_cache
from changeloom.llm.word_table import WordTable, byte_letters, tokenizer

_tables: dict[str, WordTable] = worker_cache()


def word_table(path: str) -> WordTable:
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def pieces_of(batch: pa.RecordBatch, text_col: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about SUB_BATCH_CHARS characters."""
    text = batch.column(batch.schema.get_field_index(text_col))
    size = pc.binary_length(text).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.cumsum(size) // SUB_BATCH_CHARS
    starts = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(text)]
    for a, z in zip(starts[:-1], starts[1:], strict=True):
        if z > a:
            yield batch.slice(a, z - a)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with ids_col: the ids of text_col as the tokenizers library gives them (no added special tokens)."""
    keep = [f for f in df.schema.fields if f.name != ids_col]
    schema = T.StructType([*keep, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])
    names = [f.name for f in keep]

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for batch in batches:
            for b in pieces_of(batch, text_col):
                ids, sizes = table.encode(b.column(b.schema.get_field_index(text_col)))
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                out = [b.column(b.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*out, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=[*names, ids_col])

    return df.mapInArrow(run, schema)


_pieces: dict[str, list[bytes]] = worker_cache()


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; ids of special strings give those strings."""
    if path not in _pieces:
        t, _ = tokenizer(path)
        size = max(t.get_vocab(with_added_tokens=True).values()) + 1
        of = {letter: c for c, letter in byte_letters().items()}
        added = {i: a.content.encode() for i, a in t.get_added_tokens_decoder().items()}
        _pieces[path] = [added.get(i, b"") or bytes(of[c] for c in t.id_to_token(i) or "") for i in range(size)]
    return _pieces[path]


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded", drop_ids: bool = False) -> DataFrame:
    """df with text_col: the text of ids_col (null ids: empty), invalid UTF-8 replaced as the library does."""
    keep = [f for f in df.schema.fields if f.name != text_col and not (drop_ids and f.name == ids_col)]
    schema = T.StructType([*keep, T.StructField(text_col, T.StringType(), False)])
    names = [f.name for f in keep]

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = piece_bytes(path).__getitem__
        for b in batches:
            out = [b.column(b.schema.get_field_index(n)) for n in names]
            ids = b.column(b.schema.get_field_index(ids_col))
            texts = [b"".join(map(piece, x.values.to_pylist() if x.is_valid else ())).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.string())], names=[*names, text_col])

    return df.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: n_tokens, digest of the ids in decimal, digest of the decoded text."""
    kept = df.select(*keep, ids_col)
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_bytes(path)
        piece, number = pieces.__getitem__, list(map(str, range(len(pieces)))).__getitem__
        for b in batches:
            n, said, back = [], [], []
            for x in b.column(len(keep)):
                ids = x.values.to_pylist() if x.is_valid else []
                n.append(len(ids))
                said.append(hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest())
                text = b"".join(map(piece, ids)).decode("utf-8", "replace")
                back.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(said), pa.array(back)], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)


def encode_stage(docs: DataFrame, path: str) -> DataFrame:
    """Pipeline form: the documents with n_tokens and ids."""
    out = encode(docs, path)
    return out.withColumn("n_tokens", F.size("ids").cast("long"))
