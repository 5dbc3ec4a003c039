"""Operator 3: token counts by rank-synchronous merging of ragged numpy arrays.

Pre-tokens of a batch are held as one flat symbol array with sequence starts. In each round every sequence merges its
lowest-rank pair; the symbols that survive are counted. Each distinct pre-token is merged once while it is in a bounded table.

All occurrences of a sequence's lowest-rank pair merge in one round when no pair made by that merge can rank lower;
otherwise only the leftmost does, which is what a queue ordered by (rank, position) gives.

Null and empty texts have 0 bytes and 0 tokens; other columns pass through when named in `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from changeloom.llm.common import coded, columns, in_worker, worker_cache

_NEVER = np.int32(2**31 - 1)
_SPACE = "▁"
_RUNS = re.compile("▁+[^▁]*")


class MergeRanks:
    """Merge ranks of a sentencepiece BPE model with byte fallback, as sorted arrays over pairs of symbol numbers."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        usual = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = [sp.id_to_piece(i) for i in usual]
        score = np.array([sp.get_score(i) for i in usual])
        rank = np.empty(len(usual), np.int64)
        rank[np.argsort(-score, kind="stable")] = np.arange(len(usual))
        _, place = np.unique(-score, return_inverse=True)  # equal scores have equal ranks
        self.number = {t: k for k, t in enumerate(text)}
        known = set(self.number)
        for c in sorted({c for t in text for c in t} - known):
            self.number[c] = len(self.number)
        n = len(self.number)
        #: Tokens that a symbol counts for: characters without a piece fall back to their bytes.
        self.weight = np.array([1 if t in known else len(t.encode()) for t in self.number] + [1, 2, 3, 4], np.int64)
        self.base, self.size = n, n + 4
        left, right, made, ranks = [], [], [], []
        for t, r in zip(text, place.tolist(), strict=True):
            for k in range(1, len(t)):
                a, b = self.number.get(t[:k]), self.number.get(t[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(self.number[t]), ranks.append(r)
        key = np.array(left, np.int64) * self.size + np.array(right, np.int64)
        order = np.argsort(key)
        self.key, self.made, self.rank = key[order], np.array(made, np.int32)[order], np.array(ranks, np.int32)[order]
        self.slots, self.probes = self.hashed(self.key)
        best = np.full(self.size, _NEVER, np.int32)
        np.minimum.at(best, np.array(left, np.int64), np.array(ranks, np.int32))
        np.minimum.at(best, np.array(right, np.int64), np.array(ranks, np.int32))
        self.safe = best[self.made] >= self.rank
        chars = sorted(c for c in self.number if len(c) == 1)
        self.char = np.full(0x110000, -1, np.int32)
        self.char[[ord(c) for c in chars]] = [self.number[c] for c in chars]

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.char[points]
        if len(lost := np.flatnonzero(out < 0)):
            p = points[lost]
            out[lost] = self.base + (p >= 0x80).astype(np.int32) + (p >= 0x800) + (p >= 0x10000)
        return out

    @staticmethod
    def slot(key: np.ndarray, bits: int = 20) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def hashed(self, key: np.ndarray) -> tuple[np.ndarray, int]:
        """An open hash table of places in `key`, and the most steps that a search takes."""
        slots, todo, at, steps = np.full((1 << 20) + 64, -1, np.int32), np.arange(len(key)), self.slot(key), 0
        while len(todo):
            steps += 1
            free = slots[at] < 0
            slots[at[free]] = todo[free]
            lost = slots[at] != todo
            todo, at = todo[lost], at[lost] + 1
        return slots, steps

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, or _NEVER, and its place in the table."""
        key = left.astype(np.int64) * self.size + right
        where = self.slot(key)
        at = self.slots[where]
        rank = np.where((at >= 0) & (self.key[at] == key), self.rank[at], _NEVER)
        left_over = np.flatnonzero((at >= 0) & (rank == _NEVER))
        for _ in range(self.probes - 1):
            if not len(left_over):
                break
            where[left_over] += 1
            at[left_over] = now = self.slots[where[left_over]]
            found = (now >= 0) & (self.key[now] == key[left_over])
            rank[left_over[found]] = self.rank[now[found]]
            left_over = left_over[(now >= 0) & ~found]
        return rank, at

    def counts(self, chunks: list[str]) -> np.ndarray:
        """Surviving symbols of every chunk."""
        out = np.zeros(len(chunks), np.int64)
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        sym, seq = self.symbols("".join(chunks)), np.repeat(np.arange(len(chunks)), lens)
        while len(sym):
            last = np.append(seq[1:] != seq[:-1], True)
            rank, at = np.full(len(sym), _NEVER, np.int32), np.zeros(len(sym), np.int32)
            inner = np.flatnonzero(~last)
            if len(inner):
                rank[inner], at[inner] = self.pairs(sym[inner], sym[inner + 1])
            starts = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(rank, starts)
            over = least == _NEVER
            sizes = np.diff(np.append(starts, len(sym)))
            if over.any():
                done = np.repeat(over, sizes)
                out += np.bincount(seq[done], weights=self.weight[sym[done]], minlength=len(out)).astype(np.int64)
                keep = ~done
                sym, seq, rank, at = sym[keep], seq[keep], rank[keep], at[keep]
                least, sizes = least[~over], sizes[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            first = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
            # Equal ranks may come from different pairs of one text: only occurrences of the leftmost pair count as safe.
            lead = np.repeat(at[hit[first]], np.diff(np.append(np.flatnonzero(first), len(hit))))
            use = first | (self.safe[at[hit]] & (at[hit] == lead))
            hit = hit[use]
            if len(hit) > 1:
                run = np.append(True, (hit[1:] != hit[:-1] + 1) | (seq[hit[1:]] != seq[hit[:-1]]))
                begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


class PieceCounts:
    """Pre-token -> number of tokens, for the pre-tokens that this Python worker met; reset beyond `limit`.

    A pre-token is a run of spaces with what follows it: no piece has a space after another character. Line breaks are
    pre-tokens too, as no piece has one."""

    def __init__(self, path: str, limit: int = 600_000):
        self.ranks, self.limit, self.seen = MergeRanks(path), limit, {}
        if any("\n" in t or _SPACE in t.lstrip(_SPACE) for t in self.ranks.number):
            raise ValueError("the model has pieces that cross spaces or line breaks")

    def of(self, chunks: pa.Array) -> np.ndarray:
        said = chunks.to_pylist()
        if new := [c for c in said if c not in self.seen]:
            self.seen.update(zip(new, self.ranks.counts(new).tolist(), strict=True))
        return np.fromiter(map(self.seen.__getitem__, said), np.int64, len(said))

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of every text; null: 0."""
        if len(self.seen) > self.limit:
            self.seen = {}
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, "  |▁|^ |\\x00")
        cut = pc.if_else(odd, "", texts)
        cut = pc.replace_substring(pc.replace_substring(cut, " ", "\0" + _SPACE), "\n", "\0\n\0")
        cut = pc.if_else(pc.equal(cut, ""), "", pc.binary_join_element_wise(_SPACE, cut, ""))
        codes, chunks, lens = coded(pc.split_pattern(cut, "\0"))
        each = self.of(chunks)[codes] if len(codes) else np.zeros(0, np.int64)
        out = np.diff(np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(lens)])])
        if (rows := np.flatnonzero(odd.to_numpy(zero_copy_only=False))).size:
            split = [_RUNS.findall(_SPACE + t.replace(" ", _SPACE)) for t in texts.take(pa.array(rows)).to_pylist()]
            codes, chunks, lens = coded(pa.array(split, pa.list_(pa.string())))
            out[rows] = np.diff(np.concatenate([[0], np.cumsum(self.of(chunks)[codes])])[np.concatenate([[0], np.cumsum(lens)])])
        return out


_counts: dict[str, PieceCounts] = worker_cache()


def token_counts(df: DataFrame, path: str, limit: int = 4096, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the columns `keep`, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    kept = df.select(*keep, text_col)
    schema = T.StructType([*kept.schema.fields[: len(keep)], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counts:
            _counts[path] = PieceCounts(path)
        for *cols, text in columns(batches, *keep, text_col):
            size = pc.binary_length(text).fill_null(0).cast(pa.int64())
            n = _counts[path].count(text)
            yield pa.RecordBatch.from_arrays([*cols, size, pa.array(n), pa.array(n > limit)], names=[f.name for f in schema])

    return kept.mapInArrow(run, schema)
