"""Token blocks, token counts and word-table BPE against the libraries."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from changeloom.llm import token_blocks, token_count, word_bpe
from changeloom.llm.word_table import WordTable

PARTS = ["a", "the", " ", "  ", "   ", "\n", "\t", "é", "é", "▁", "ｆ", "中", "\U0001f600", "<s>", "</s>", "<unk>", "<0x0A>", "23", "aaaa", "'s", "'", "!", "...", " ", "　", "\x1c", "\x85", "\x00", "<|endoftext|>", "<|STARTOFTEXT|>", "ΑΣ", "İ", "ﬁ", "\r\n", "-", "​", "ß", "X", "́", "word.", "Two,three", "½"]


def texts(n=3000):
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["a" * 3000, "ab" * 900, " " * 500, "the " * 400, "", None]


def ids_of(table, said):
    ids, sizes = table.encode(pa.array(said, pa.string()))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:])]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_table_is_the_library(name):
    path, said = public_tokenizers.path(name), texts()
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in said], add_special_tokens=False)]
    assert ids_of(WordTable(path), said) == want
    small = WordTable(path, limit=10)  # a table that starts anew all the time
    assert ids_of(small, said[:100]) + ids_of(small, said[100:200]) == want[:200]


def test_decode_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, pieces = Tokenizer.from_file(path), word_bpe.piece_bytes(path)
    r = random.Random(1)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randrange(20))]
        assert b"".join(pieces[i] for i in ids).decode("utf-8", "replace") == t.decode(ids, skip_special_tokens=False)


def test_counts_are_the_library():
    path, said = public_tokenizers.path("piece_bpe_32k.model"), texts()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_count.PieceCounts(path).count(pa.array(said, pa.string())).tolist() == [len(sp.encode(t or "")) for t in said]


def test_count_columns_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "x y", 9), (None, "x y", 9)], "doc_id long, text string, n_tokens int")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs, path, limit=1).collect())
    assert got == [(0, 3, 2, True), (1, 0, 0, False), (2, 0, 0, False), (2, 3, 2, True)]
    assert token_count.token_counts(docs.where("false"), path).count() == 0


def test_blocks_round_trip():
    r = np.random.default_rng(3)
    for ids in ([], [7], list(range(2000)), r.integers(0, 2**32, 5000).tolist(), [5] * 1024, [0, 2**32 - 1] * 700, (r.zipf(1.3, 9000) % 50000).tolist()):
        ids = np.array(ids, np.uint32)
        blocks = token_blocks.encode_blocks(ids)
        back = [token_blocks.decode_block(memoryview(b), min(1024, len(ids) - 1024 * k)) for k, b in enumerate(blocks)]
        assert (np.concatenate(back) if back else np.zeros(0)).tolist() == ids.tolist()


def test_file_round_trip():
    sink = io.BytesIO()
    w = token_blocks.Writer(sink)
    docs = [(None, [2]), (3, list(range(3000))), (3, []), (-5, [1, 2])]
    for d, ids in docs:
        w.add([d], np.array([len(ids)]), np.array(ids, np.int64))
    w.close()
    assert [(d, i.tolist()) for d, i in token_blocks.read_file(memoryview(sink.getvalue()), group=1)] == docs
    with pytest.raises(ValueError):
        list(token_blocks.read_file(memoryview(sink.getvalue()[:-1] + b"x")))


def test_files_are_in_order_of_doc_id(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    said = [(k * 7 % 101, f"word {k} Two" if k % 5 else None) for k in range(101)]
    docs = spark.createDataFrame(said, "doc_id long, text string").repartition(5)
    files = token_blocks.write(docs, path, end_id=2, n_files=4)
    assert len(files) > 1
    t, start = Tokenizer.from_file(path), 0
    got = {r.doc_id: r for r in token_blocks.read(spark, files, digest=True).collect()}
    whole = {r.doc_id: r.ids for r in token_blocks.read(spark, files).collect()}
    for d, text in sorted(said):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[d] == ids
        start += len(ids)
    assert token_blocks.read(spark, token_blocks.write(docs.where("false"), path, 2)).count() == 0


def test_encode_and_decode_frames(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    said = [t for t in texts(200)]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(said)], "doc_id long, text string, ids string")
    coded = word_bpe.encode(docs, path)
    assert coded.columns == ["doc_id", "text", "ids"]
    t = Tokenizer.from_file(path)
    for r in word_bpe.decode(coded, path).collect():
        assert r.ids == t.encode(said[r.doc_id] or "", add_special_tokens=False).ids and r.decoded == t.decode(r.ids, skip_special_tokens=False)
    for r in word_bpe.digests(coded, path).collect():
        ids = t.encode(said[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.n_tokens == len(ids)
