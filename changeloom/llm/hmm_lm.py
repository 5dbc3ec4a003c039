"""Operator 9: a hidden Markov language model.

Tokens are words in lower case (A-Z) and one end a text. Hidden states emit token classes: each of the most frequent tokens is a
class of its own, all others share SHARED classes by their last two characters. Within a class a token has the probability
(c + 1) / (n + v + 1), with its training count c, the class's training tokens n and distinct tokens v, so one share is left
for tokens never seen. The probability of a text is that of its classes, by the scaled forward recursion, times those inside classes.

Training: token counts over all training texts are gathered by shuffle; Baum-Welch starts from these counts with random shares of the
states. Each pass goes over all training texts, whose expected counts are summed within and then across partitions. Passes end when one
gains less than GAIN of the mean log probability of a token, and after PASSES at most. The texts' classes are written once, in the
order in which the recursion meets them (all first tokens, all second ones, ...), to be read by every pass. Passes compute in single precision and sum in
double; scores are computed in double.

Counts of the HOT most frequent tokens (a bounded number) travel to every task. The other tokens of each text are joined to
their counts by shuffle and summed by text.

Null and empty texts are one end. Rows without a doc_id are scored, but belong neither to the training nor to the held-out texts.
Rows that share a doc_id are scored one by one, and each counts in training. With no training text all counts are zero. A text of n tokens takes
n steps of the recursion, which other texts of its batch share; very long texts take time in proportion to their length. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import ascii_words, columns, discard, in_worker, materialize

STATES, OWN, SHARED, HOT, LONG = 8, 4096, 256, 200_000, 64
PASSES, GAIN = 13, 0.001
#: Characters of a batch: the more, the more texts share a step of the recursion.
CHARS = 6 << 20
#: Stands for the end of a text; no word holds white space.
END = "\n"
SMOOTH = 0.01


def training(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 != 2


def token_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over the texts, ends included."""

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (text,) in columns(batches, "text"):
            codes, words, _ = ascii_words(text)
            n = np.bincount(codes, minlength=len(words)) if len(words) else np.zeros(0, np.int64)
            some = pa.array(n > 0)
            said = pa.concat_arrays([words.filter(some), pa.array([END])])
            yield pa.RecordBatch.from_arrays([said, pa.array(np.append(n[n > 0], len(text)))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def least_count(hist: list[tuple[int, int]], most: int) -> int:
    """The least count c such that at most `most` tokens have c or more."""
    total, least = 0, (hist[0][0] + 1 if hist else 1)
    for c, n in hist:
        total += n
        if total > most:
            break
        least = c
    return least


@dataclass
class Model:
    total: int  # training tokens
    distinct: int
    hot: dict[str, int]  # counts of the most frequent tokens
    own: dict[str, int]  # token -> its own class
    inside: np.ndarray  # log10 (n + v + 1) of each shared class
    start: np.ndarray = field(default_factory=lambda: np.full(STATES, 1 / STATES))
    move: np.ndarray = field(default_factory=lambda: np.full((STATES, STATES), 1 / STATES))
    emit: np.ndarray | None = None  # class x state
    passes: int = 0

    @property
    def classes(self) -> int:
        return len(self.own) + SHARED

    def class_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word its own class (or -1), and the shared class of its last two characters."""
        tail = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
        shared = np.array([len(self.own) + zlib.crc32(t.encode()) % SHARED for t in tail.dictionary.to_pylist()], np.int64)
        return np.array([self.own.get(w, -1) for w in words.to_pylist()], np.int64), shared[tail.indices.to_numpy(zero_copy_only=False)]

    def sequences(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Classes of all tokens, ends included; tokens a text; distinct words and the codes of all words."""
        codes, words, lens = ascii_words(text)
        own, shared = self.class_of(words) if len(words) else (np.zeros(0, np.int64),) * 2
        kind = np.where(own >= 0, own, shared)
        seq = np.insert(kind[codes] if len(codes) else np.zeros(0, np.int64), np.cumsum(lens), self.own[END])
        return seq, lens + 1, words, codes


def by_step(seq: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All first tokens, then all second ones, ...: the classes, the number of tokens of each step, and the sequences' order in every step."""
    order = np.argsort(-count, kind="stable")
    n, start = count[order], (np.cumsum(count) - count)[order]
    size = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    first = np.cumsum(size) - size
    at = start[np.arange(int(size.sum())) - np.repeat(first, size)] + np.repeat(np.arange(len(size)), size)
    return seq[at], size, order


def forward(model: Model, seq: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Natural log of each sequence's probability, by the scaled forward recursion."""
    seq, size, order = by_step(seq, count)
    ends = np.concatenate([[0], np.cumsum(size)]).tolist()
    p = model.emit[seq]
    scale, ones = np.ones((len(seq), 1)), np.ones((STATES, 1))
    prior = np.tile(model.start, (len(count), 1))
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        x = p[a:z]
        x *= prior[: z - a]
        s = np.matmul(x, ones, out=scale[a:z])
        x /= s
        prior = x @ model.move
    place = np.arange(len(seq)) - np.repeat(ends[:-1], size)
    out = np.zeros(len(count))
    out[order] = np.bincount(place, weights=np.log(scale[:, 0]), minlength=len(count))
    return out


def expected(model: Model, seq: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch over sequences in the order of by_step(): expected starts, moves and emissions, and the log probability of all."""
    if not len(seq):
        return np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((model.classes, STATES)), 0.0
    ends = np.concatenate([[0], np.cumsum(size)]).tolist()
    step = model.move.astype(np.float32)
    p = model.emit.astype(np.float32)[seq]
    gamma, scale, ones = np.empty_like(p), np.empty((len(seq), 1), np.float32), np.ones((STATES, 1), np.float32)
    prior = np.tile(model.start.astype(np.float32), (size[0], 1))
    for a, z in zip(ends[:-1], ends[1:], strict=True):
        x, g = p[a:z], gamma[a:z]
        np.multiply(prior[: z - a], x, out=g)
        s = np.matmul(g, ones, out=scale[a:z])
        np.reciprocal(s, out=s)
        x *= s
        g *= s
        prior = g @ step
    move = np.zeros((STATES, STATES))
    beta = np.ones((int(size[0]), STATES), np.float32)
    back = np.ascontiguousarray(step.T)
    for t in range(len(size) - 2, -1, -1):
        a, z = ends[t + 1], ends[t + 2]
        k = z - a
        b = p[a:z]
        b *= beta[:k]
        before = gamma[ends[t] : ends[t] + k]
        move += before.T @ b
        np.matmul(b, back, out=beta[:k])
        before *= beta[:k]
    emit = np.stack([np.bincount(seq, weights=gamma[:, s], minlength=model.classes) for s in range(STATES)], axis=1)
    return gamma[: size[0]].sum(axis=0, dtype=float), move * model.move, emit, -float(np.log(scale).sum(dtype=float))


def update(model: Model, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
    model.start = (first + SMOOTH) / (first + SMOOTH).sum()
    model.move = (move + SMOOTH) / (move + SMOOTH).sum(axis=1, keepdims=True)
    model.emit = (emit + SMOOTH) / (emit + SMOOTH).sum(axis=0, keepdims=True)


def classes_of(texts: DataFrame, model: Model) -> DataFrame:
    """(seq, size): the classes of many texts a row in the order of by_step(), and the number of tokens of each step, as bytes."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for (text,) in columns(batches, "text", chars=CHARS):
            seq, size, _ = by_step(*m.sequences(text)[:2])
            yield pa.RecordBatch.from_arrays([pa.array([seq.astype(np.min_scalar_type(m.classes)).tobytes()], pa.binary()), pa.array([size.astype(np.int64).tobytes()], pa.binary())], names=["seq", "size"])

    return texts.select("text").mapInArrow(run, "seq binary, size binary")


def expected_over(chained: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch: expected starts, moves and emissions over all rows of classes_of, and the log probability of all."""
    shared = chained.sparkSession.sparkContext.broadcast(Model(0, 0, {}, model.own, model.inside, model.start, model.move, model.emit))
    names = [f"x{s}" for s in range(STATES)]

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        sums = np.zeros((2 + STATES + m.classes, STATES))
        for b in batches:
            for seq, size in zip(b.column(0), b.column(1), strict=True):
                kind = np.frombuffer(seq.as_buffer(), np.min_scalar_type(m.classes)).astype(np.int64)
                first, move, emit, log_p = expected(m, kind, np.frombuffer(size.as_buffer(), np.int64))
                sums += np.vstack([np.full(STATES, log_p)[None], first[None], move, emit])
        row = np.flatnonzero(sums.any(axis=1))
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array(row), *(pa.array(sums[row, s]) for s in range(STATES))], names=["row", *names])

    sums = np.zeros((2 + STATES + model.classes, STATES))
    rows = chained.mapInArrow(run, "row long, " + ", ".join(f"{x} double" for x in names))
    for r in rows.groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).collect():
        sums[r.row] = r[1:]
    shared.unpersist()
    return sums[1], sums[2 : 2 + STATES], sums[2 + STATES :], float(sums[0, 0])


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of all training counts."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id"), "text").where(training())
    counts = materialize(token_counts(texts), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hist = [(r.c, r["count"]) for r in counts.groupBy("c").count().orderBy(F.desc("c")).collect()]
    short = F.length("word") <= LONG
    frequent = counts.where((F.col("c") >= least_count(hist, HOT)) & short).collect()
    hot = {r.word: r.c for r in frequent}
    limit = least_count(hist, OWN)
    own = sorted(w for w, c in hot.items() if c >= limit and w != END)
    own = {w: k for k, w in enumerate([END, *own])}
    hot.setdefault(END, 0)
    shared = (F.crc32(F.substring("word", -2, 2).cast("binary")) % SHARED).cast("int")
    rest = counts.where(((F.col("c") < limit) | ~short) & (F.col("word") != END)).groupBy(shared.alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    inside = np.ones(SHARED)
    for r in rest:
        inside[r.k] += r.n + r.v
    model = Model(total, distinct, hot, own, np.log10(inside))

    seen = np.ones(model.classes)
    seen[: len(own)] += [hot[w] for w in own]
    for r in rest:
        seen[len(own) + r.k] += r.n
    noise = np.random.default_rng(9).dirichlet(np.ones(STATES), model.classes) * STATES
    update(model, np.ones(STATES), np.ones((STATES, STATES)) + 20 * np.eye(STATES), seen[:, None] * noise)
    if total:
        chained = materialize(classes_of(texts, model), "classes")
        before = -np.inf
        while model.passes < PASSES:
            *counts_of, log_p = expected_over(chained, model)
            update(model, *counts_of)
            model.passes += 1
            if log_p - before < GAIN * abs(log_p):
                break
            before = log_p
        discard(chained)
    return model, counts


def scored(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, hot double, chain double, tail map<string,int>"

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        at = TaskContext.get().partitionId() << 40
        for ids, held, text in columns(batches, "doc_id", "held_out", "text", chars=CHARS):
            seq, count, words, codes = m.sequences(text)
            c = np.array([m.hot.get(w, -1) for w in words.to_pylist()], np.int64)
            own, kind = m.class_of(words) if len(words) else (np.zeros(0, np.int64),) * 2
            inside = np.where(own >= 0, 0.0, -m.inside[kind - len(m.own)])
            log_c = np.log10(np.maximum(c, 0) + 1.0)
            #: log10 (c + 1) counts for the base score always, for the model's only inside shared classes.
            row = np.repeat(np.arange(len(count)), count - 1)
            sums = lambda x: np.bincount(row, weights=x[codes], minlength=len(count)) if len(codes) else np.zeros(len(count))
            end = m.hot[END]
            hot = sums(log_c) + np.log10(end + 1.0)
            chain = forward(m, seq, count) / np.log(10) + sums(inside + np.where(own >= 0, 0.0, log_c))
            known = sums((c > 0).astype(float)) + (end > 0)
            rare = np.flatnonzero(c[codes] < 0) if len(codes) else np.zeros(0, np.int64)
            pair, n = np.unique(row[rare] * max(1, len(words)) + codes[rare], return_counts=True)
            ends = np.searchsorted(pair, np.arange(len(count) + 1) * max(1, len(words))).astype(np.int32)
            tail = pa.MapArray.from_arrays(pa.array(ends), words.take(pa.array(pair % max(1, len(words)))), pa.array(n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), held, pa.array(at + np.arange(len(count))), pa.array(count), pa.array(known.astype(np.int64)), pa.array(hot), pa.array(chain), tail],
                names=["doc_id", "held_out", "row", "n_tokens", "n_known", "hot", "chain", "tail"],
            )
            at += len(count)

    held = F.coalesce(~training(), F.lit(False)).alias("held_out")
    rows = materialize(docs.select("doc_id", held, "text").mapInArrow(run, names), "rows")
    tail = rows.select("row", F.explode("tail").alias("word", "n"))
    found = tail.join(counts, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("seen"))
    more = F.coalesce("more", F.lit(0.0))
    base = np.log10(model.total + model.distinct + 1.0)
    return rows.drop("tail").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(int(model.total)).cast("long").alias("train_tokens"),
        (F.col("hot") + more - F.col("n_tokens") * F.lit(float(base))).alias("base_score"),
        (F.col("chain") + more).alias("score"),
    )
