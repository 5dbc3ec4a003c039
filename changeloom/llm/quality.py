"""Operator 5: document quality by a linear-chain conditional random field over lines.

Each line is good or bad. Its features are measured on the line and on its neighbours; transitions tie neighbouring lines.
Labels exist for documents only: label 1 says that all lines are good, label 0 that not all are; the likelihood of these two
events under the field is what training climbs. Forward-backward gives the probability that each line is good; their mean,
weighted by length, is mapped to the probability of label 1 by a logistic curve fitted on the same sample.

Training uses at most TRAIN_DOCS labelled documents (those of least hash, of at most TRAIN_LINES lines each), chosen outside the
held-out fold; only their features reach the driver. Scoring covers every whole text.

A null or empty text counts as one empty line. Labels that are null or stand twice in conflict are not used; rows without a
doc_id are scored like others and belong to no fold (held_out is false). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import ascii_words, columns, in_worker

TRAIN_DOCS, TRAIN_LINES, STEPS = 4000, 2000, 250
_KINDS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "|", "#$%&*+<=>@[\\]^_`{}~/", "!?", ".,;:'\"()-")
_KIND = np.full(256, len(_KINDS), np.uint8)
for _k, _signs in enumerate(_KINDS):
    _KIND[[ord(c) for c in _signs]] = _k
N = len(_KINDS) + 6


def line_features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in characters, and the number of lines of each text."""
    lines = pc.split_pattern(text.fill_null(""), "\n")
    count = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lines.flatten()
    size = pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(pc.binary_join(pa.array([flat.to_pylist()], pa.list_(pa.string())), "")[0].as_buffer(), np.uint8)
    starts = np.cumsum(size) - size
    out = np.zeros((len(flat), N), np.float32)
    some = np.flatnonzero(size)
    if len(some):
        kind = _KIND[data]
        for k in range(len(_KINDS)):
            out[some, k] = np.add.reduceat(kind == k, starts[some], dtype=np.int64) / size[some]
    codes, words, lens = ascii_words(flat)
    n = np.maximum(lens, 1)
    line = np.repeat(np.arange(len(flat)), lens)
    kinds = np.bincount(np.unique(line * max(1, len(words)) + codes) // max(1, len(words)), minlength=len(flat)) if len(codes) else np.zeros(len(flat))
    again = (codes[1:] == codes[:-1]) & (line[1:] == line[:-1])
    k = len(_KINDS)
    out[:, k] = 1 - out[:, :k].sum(axis=1)
    out[:, k + 1] = kinds / n
    out[:, k + 2] = np.bincount(line[1:][again], minlength=len(flat)) / n
    out[:, k + 3] = np.log1p(lens)
    out[:, k + 4] = np.log1p(chars / n)
    out[:, k + 5] = lens == 0
    return out, np.maximum(chars, 1), count


def with_neighbours(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Features of a line, of the line before and of the line after; absent lines are zero and flagged; a constant."""
    first = np.zeros(len(x), bool)
    last = first.copy()
    ends = np.cumsum(count)
    first[ends - count] = True
    last[ends - 1] = True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1), x.dtype)])


def marginals(node: np.ndarray, edge: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains with log potentials node (line, state) and edge (state, state): each line's state probabilities, expected
    transitions of each chain, and the log of the partition function of each chain. Chains advance side by side."""
    order = np.argsort(-count, kind="stable")
    n, start = count[order], (np.cumsum(count) - count)[order]
    longest = int(n[0]) if len(n) else 0
    alive = [int(np.searchsorted(-n, -t, side="left")) for t in range(longest)]  # chains with more than t lines
    e = np.exp(edge)
    peak = node.max(axis=1, keepdims=True)
    p = np.exp(node - peak)
    alpha, beta, scale = np.zeros_like(p), np.ones_like(p), np.ones(len(p))
    for t in range(longest):
        at = start[: alive[t]] + t
        a = p[at] if t == 0 else (alpha[at - 1] @ e) * p[at]
        scale[at] = a.sum(axis=1)
        alpha[at] = a / scale[at][:, None]
    pair = np.zeros((len(count), 2, 2))
    for t in range(longest - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        b = p[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = b @ e.T
        pair[order[: alive[t + 1]]] += alpha[at][:, :, None] * e[None] * b[:, None, :]
    chain = np.repeat(np.arange(len(count)), count)
    logz = np.bincount(chain, weights=np.log(scale) + peak[:, 0], minlength=len(count))
    return alpha * beta, pair, logz


@dataclass
class Field:
    """Weights of the field; state 1 is good. Node scores are those of good against bad."""

    mean: np.ndarray
    spread: np.ndarray
    node: np.ndarray
    edge: np.ndarray
    curve: tuple[float, float]

    def ready(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.spread, count)

    def goodness(self, x: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Length-weighted mean probability that a document's lines are good."""
        z = self.ready(x, count) @ self.node
        prob, _, _ = marginals(np.stack([np.zeros_like(z), z], axis=1), self.edge, count)
        chain = np.repeat(np.arange(len(count)), count)
        return np.bincount(chain, weights=prob[:, 1] * size) / np.bincount(chain, weights=size)

    def score(self, x: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
        g = np.clip(self.goodness(x, size, count), 1e-4, 1 - 1e-4)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.log(g / (1 - g)) + b)))


def fit(x: np.ndarray, size: np.ndarray, count: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
    """Climb the likelihood of the document labels (Adam), then fit the logistic curve."""
    field = Field(x.mean(axis=0), x.std(axis=0) + 1e-3, np.zeros(3 * x.shape[1] + 3), np.zeros((2, 2)), (1.0, 0.0))
    if not len(label):
        return field
    f = field.ready(x, count).astype(np.float64)
    chain = np.repeat(np.arange(len(count)), count)
    moves = np.maximum(count - 1, 0)
    params = np.zeros(f.shape[1] + 4)
    params[f.shape[1] - 1] = 2.0
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        z, edge = f @ params[:-4], params[-4:].reshape(2, 2)
        prob, pair, logz = marginals(np.stack([np.zeros_like(z), z], axis=1), edge, count)
        all_good = np.minimum(np.bincount(chain, weights=z) + moves * edge[1, 1] - logz, -1e-9)
        p = np.exp(all_good)
        factor = np.where(label == 1, 1.0, -p / np.maximum(1 - p, 1e-6)) / len(label)
        up = np.concatenate([f.T @ ((1 - prob[:, 1]) * factor[chain]), -np.einsum("c,cij->ij", factor, pair).ravel()])
        up[-1] += (factor * moves).sum()
        up -= 1e-4 * params
        m, v = 0.9 * m + 0.1 * up, 0.999 * v + 0.001 * up * up
        params += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    field.node, field.edge = params[:-4], params[-4:].reshape(2, 2)
    g = np.clip(field.goodness(x, size, count), 1e-4, 1 - 1e-4)
    field.curve = logistic(np.log(g / (1 - g)), label)
    return field


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a x + b))) by Newton's method with a small penalty."""
    w, design = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (y - p) - 1e-2 * w
        w = w + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), slope)
    return float(max(w[0], 1e-3)), float(w[1])


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Field:
    """The field fitted to a bounded sample of the labelled documents outside the held-out fold."""
    told = labels.where("doc_id is not null and quality in (0, 1)").where(fold() != 2).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2"))
    sample = told.where("q = q2").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("_id"), "q")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "q", "text")

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, q, text in columns(batches, "doc_id", "q", "text"):
            x, size, count = line_features(text)
            ends = np.cumsum(count)
            at = [(int(a), int(z)) for a, z in zip(ends - count, ends, strict=True)]
            keep = [k for k, c in enumerate(count) if c <= TRAIN_LINES]
            cols = [ids.take(pa.array(keep, pa.int64())).cast(pa.int64()), q.take(pa.array(keep, pa.int64())).cast(pa.int32())]
            cols += [pa.array([x[a:z].tobytes() for k, (a, z) in enumerate(at) if count[k] <= TRAIN_LINES], pa.binary())]
            cols += [pa.array([size[a:z].tobytes() for k, (a, z) in enumerate(at) if count[k] <= TRAIN_LINES], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "q", "x", "size"])

    got = sorted(rows.mapInArrow(run, "doc_id long, q int, x binary, size binary").collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    x = [np.frombuffer(r.x, np.float32).reshape(-1, N) for r in got]
    size = [np.frombuffer(r.size, np.int64) for r in got]
    label, count = np.array([r.q for r in got], np.int64), np.array([len(s) for s in size], np.int64)
    return fit(np.concatenate(x) if x else np.zeros((0, N), np.float32), np.concatenate(size) if size else np.zeros(0), count, label) if x else _untrained()


def _untrained() -> Field:
    return Field(np.zeros(N), np.ones(N), np.zeros(3 * N + 3), np.zeros((2, 2)), (1.0, 0.0))


def scored(docs: DataFrame, field: Field, threshold: float = 0.7) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, text in columns(batches, "doc_id", "held_out", "text"):
            s = shared.value.score(*line_features(text))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), held, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pipeline form: the documents that score at least the threshold; columns as given. Each row is judged by its own text."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    place = docs.columns.index("text")

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from changeloom.llm.word_bpe import pieces_of

        for batch in batches:
            for b in pieces_of(batch, "text"):
                yield b.filter(pa.array(shared.value.score(*line_features(b.column(place))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
