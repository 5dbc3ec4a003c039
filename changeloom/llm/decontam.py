"""Operator 6: benchmark decontamination with a BM25 index and block-max WAND.

The test items are the indexed side. Weights are BM25 scores divided by the item's score for its own words, so a passage that
holds all words of an item scores 1. Items of more than SEGMENT words are indexed whole and also as consecutive segments of at most
SEGMENT words, each with weights that sum to 1; an item's score is that of its best entry. A segment lies inside one passage
wherever it stands, so an item copied word for word is retrieved at any length. Every passage of every document (a window of WINDOW words, one each STEP words) is a
query; all items with a score of at least `threshold` are retrieved by block-max WAND, behind a bound that sums the largest
weight of each distinct word of a window. Retrieved pairs are verified on the document's whole text: the share of the
item's word 5-grams that end in its question, and of those that end in its answer (its last sentence), must both reach `overlap`.

The index is built from at most SHARD_WORDS words at a time; a larger benchmark is dealt to several shards, each of which scans
the documents once, with weights from all items of the benchmark. Null texts have no words; items of fewer than 5 words are never reported; an empty table gives no rows. Rows
that share a doc_id are checked one by one, and so are rows without one: a row goes from the corpus for what its own text holds. Very long texts are
searched a window at a time. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import ascii_words, columns, in_worker, mix, word_hashes

WINDOW, STEP, GRAM, BLOCK = 64, 32, 5, 16
#: Any run of so many words lies inside one passage.
SEGMENT = WINDOW - STEP
SHARD_WORDS = 1_000_000
#: Words in more than this share of the items (and in more than three) have no weight.
COMMON = 0.03
K1, B = 1.2, 0.75
PAIRS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def plain(words: pa.Array) -> pa.Array:
    """Words in lower case without any sign but letters and digits."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\pL\pN]+", "")


def parts(words: list[str]) -> list[list[str]]:
    """The words, and if they are more than SEGMENT also consecutive segments of nearly equal length."""
    n = -(-len(words) // SEGMENT)
    return [words] + [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)] * (n > 1)


def rolled(h: np.ndarray) -> np.ndarray:
    """Hashes of all runs of GRAM word hashes."""
    n = max(0, len(h) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out += mix(h[k : k + n] + np.uint64(k + 1))
    return mix(out)


class Index:
    """Impact-ordered blocks of postings, sorted by entry (an item, or a segment of a long one), and the 5-grams of every item."""

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, int, dict[str, int]] | None = None):
        """whole: items, words and items a word (1 if not named) of the benchmark that these items are a part of."""
        self.names = [i for i, _ in items]
        text = [t or "" for _, t in items]
        codes, words, lens = ascii_words(pa.array(text, pa.string()))
        said = np.array(plain(words).to_pylist(), object)
        ends = np.concatenate([[0], np.cumsum(lens)])
        tokens = [[w for w in said[codes[a:z]] if w] for a, z in zip(ends[:-1], ends[1:], strict=True)]
        counts = [Counter(t) for t in tokens]
        df = Counter(w for c in counts for w in c)
        n, said_words = len(items), sum(map(len, tokens))
        if whole:
            n, said_words, df = whole[0], whole[1], {w: whole[2].get(w, 1) for w in df}
        mean = max(1.0, said_words / max(1, n))
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) if d <= max(3, COMMON * n) else 0.0 for w, d in df.items()}
        lists: dict[str, list[tuple[int, float]]] = {}
        self.of: list[int] = []  # the item of each entry
        for k, (c, t) in enumerate(zip(counts, tokens, strict=True)):
            each = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * len(t) / mean)) for w, f in c.items()}
            own = sum(each.values())
            if len(t) >= GRAM and not own:  # only common words: they share the weight
                each, own = dict.fromkeys(c, 1.0), float(len(c))
            for part in (parts(t) if len(t) >= GRAM else []):
                held = {w: each[w] for w in part if each[w]}
                if own := sum(held.values()):
                    for w, s in held.items():
                        lists.setdefault(w, []).append((len(self.of), s / own))
                    self.of.append(k)
        self.terms = list(lists)
        self.items = [[k for k, _ in lists[w]] for w in self.terms]
        self.weights = [[s for _, s in lists[w]] for w in self.terms]
        self.top = np.array([max(w) for w in self.weights] + [0.0])
        self.block_top = [[max(w[k : k + BLOCK]) for k in range(0, len(w), BLOCK)] for w in self.weights]
        self.grams, self.answers = [], []
        for t, raw in zip(tokens, text, strict=True):
            self.grams.append(rolled(word_hashes(pa.array(t, pa.string()))))
            self.answers.append(max(1, len(t) - answer_words(raw)))
        self.values = pa.array(self.terms, pa.string())

    def retrieve(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All entries that score at least the threshold for the distinct terms: block-max WAND with a fixed threshold."""
        end = len(self.of)
        lists = [[self.items[t][0], 0, t] for t in terms]  # current item, place, term
        found = []
        while True:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (item, _, t) in enumerate(lists):
                if item >= end:
                    break
                bound += self.top[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            # The bound from the blocks that would hold the pivot item; where each of these blocks ends, for a longer skip.
            bound, skip = 0.0, end
            for entry in lists[: pivot + 1]:
                own = self.items[entry[2]]
                block = entry[1] // BLOCK
                while (last := min(len(own), (block + 1) * BLOCK) - 1) < len(own) - 1 and own[last] < item:
                    block += 1
                if own[last] >= item:
                    bound += self.block_top[entry[2]][block]
                    skip = min(skip, own[last] + 1)
            if bound >= threshold:
                score = 0.0
                for entry in lists[: pivot + 1]:
                    self.advance(entry, item, end)
                    if entry[0] == item:
                        score += self.weights[entry[2]][entry[1]]
                        self.advance(entry, item + 1, end)
                if score >= threshold:
                    found.append((item, score))
            else:
                to = min(skip, lists[pivot + 1][0]) if pivot + 1 < len(lists) else skip
                for entry in lists[: pivot + 1]:
                    self.advance(entry, max(to, item + 1), end)

    def advance(self, entry: list[int], item: int, end: int) -> None:
        own, at = self.items[entry[2]], entry[1]
        while at < len(own) and own[at] < item:
            at += 1
        entry[0], entry[1] = (own[at] if at < len(own) else end), at

    def overlaps(self, item: int, grams: np.ndarray) -> tuple[float, float]:
        """Shares of the item's 5-grams found, of those that end in the question and of those that end in the answer."""
        hit = np.isin(self.grams[item], grams)
        cut = max(0, self.answers[item] - GRAM + 1)
        return tuple(float(x.mean()) if len(x) else 1.0 for x in (hit[:cut], hit[cut:]))


def answer_words(text: str) -> int:
    """Words of the answer: of the last sentence."""
    sentences = [s for s in pc.split_pattern_regex(pa.array([text]), r"[.!?]+\s+|\n+")[0].as_py() if any(c.isalnum() for c in s)]
    return sum(any(c.isalnum() for c in w) for w in sentences[-1].split()) if sentences else 0


def word_counts(items: DataFrame) -> tuple[int, int, dict[str, int]]:
    """Items, words, and in how many items each word stands, for words in more than one."""

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in columns(batches, "text"):
            codes, words, lens = ascii_words(text)
            said = np.array(plain(words).to_pylist(), object)
            ends = np.concatenate([[0], np.cumsum(lens)])
            tokens = [[w for w in said[codes[a:z]] if w] for a, z in zip(ends[:-1], ends[1:], strict=True)]
            df = Counter(w for t in tokens for w in set(t))
            #: The empty word stands for the items, and its n for their words.
            yield pa.RecordBatch.from_arrays([pa.array(["", *df], pa.string()), pa.array([len(tokens), *df.values()], pa.int64()), pa.array([sum(map(len, tokens)), *[0] * len(df)], pa.int64())], names=["word", "items", "n"])

    rows = items.select("text").mapInArrow(run, "word string, items long, n long").groupBy("word").agg(F.sum("items").alias("items"), F.sum("n").alias("n"))
    got = {r.word: (r["items"], r.n) for r in rows.where("word = '' or items > 1").collect()}
    total, words = got.pop("", (0, 0))
    return total, words, {w: d for w, (d, _) in got.items()}


def indexes(benchmark: DataFrame) -> list:
    """The benchmark's index as broadcast variables, one a shard."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_WORDS))
    whole = word_counts(items) if shards > 1 else None
    out = []
    for k in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k).collect() if shards > 1 else items.collect()
        out.append(spark.sparkContext.broadcast(Index(sorted((r.item_id, r.text) for r in rows), whole)))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of the documents that hold test items."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [plain.mapInArrow(_search(index, threshold, overlap), PAIRS) for index in indexes(benchmark)])


def _search(shared, threshold: float, overlap: float):
    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for ids, text in columns(batches, "doc_id", "text"):
            rows = search(index, text, threshold, overlap)
            if rows:
                at, item, score, q, a = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([index.names[i] for i in item], pa.int64()), pa.array(score), pa.array(q), pa.array(a)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _without(shared, threshold: float, overlap: float, place: int):
    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean, at = np.ones(len(b), bool), 0
            for (text,) in columns([pa.RecordBatch.from_arrays([b.column(place)], names=["text"])], "text"):
                for row, *_ in search(shared.value, text, threshold, overlap):
                    clean[at + row] = False
                at += len(text)
            yield b.filter(pa.array(clean))

    return run


def search(index: Index, text: pa.Array, threshold: float, overlap: float) -> list[tuple]:
    """(row, item, score, question overlap, answer overlap) of the verified pairs."""
    codes, words, lens = ascii_words(text)
    if not len(codes) or not index.terms:
        return []
    said = plain(words)
    term = pc.index_in(said, index.values).fill_null(-1).to_numpy(zero_copy_only=False)
    real = pc.not_equal(said, "").to_numpy(zero_copy_only=False)[codes]
    row = np.repeat(np.arange(len(lens)), lens)[real]
    codes = codes[real]
    size = np.bincount(row, minlength=len(lens))
    first = np.cumsum(size) - size
    cells = -(-size // STEP)
    cell0 = np.cumsum(cells) - cells
    cell = cell0[row] + (np.arange(len(row)) - first[row]) // STEP
    t = term[codes]
    known = np.flatnonzero(t >= 0)
    pair = np.unique(cell[known] * len(index.terms) + t[known])
    of, t = pair // len(index.terms), pair % len(index.terms)
    n = int(cells.sum())
    bound = np.bincount(of, weights=index.top[t], minlength=n + 1)
    owner = np.append(np.repeat(np.arange(len(lens)), cells), -1)
    both = bound[:-1] + np.where(owner[1:] == owner[:-1], bound[1:], 0.0)
    best: dict[tuple[int, int], float] = {}
    for k in np.flatnonzero(both >= threshold).tolist():
        a, z = np.searchsorted(of, [k, k + 2 if owner[k + 1] == owner[k] else k + 1])
        for entry, score in index.retrieve(np.unique(t[a:z]).tolist(), threshold):
            item = index.of[entry]
            best[owner[k], item] = max(score, best.get((owner[k], item), 0.0))
    out, h = [], None
    grams: dict[int, np.ndarray] = {}
    for (doc, item), score in sorted(best.items()):
        if doc not in grams:
            h = word_hashes(said) if h is None else h
            grams = {doc: rolled(h[codes[first[doc] : first[doc] + size[doc]]])}
        q, a = index.overlaps(item, grams[doc])
        if q >= overlap and a >= overlap:
            out.append((int(doc), item, float(score), q, a))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """The rows whose own text holds no test item; columns as given. Each shard of the index passes on what it leaves, without a shuffle."""
    for index in indexes(benchmark):
        docs = docs.mapInArrow(_without(index, threshold, overlap, docs.columns.index("text")), docs.schema)
    return docs
