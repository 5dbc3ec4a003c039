"""Operator 4: MinHash near-dedup with tensored banding.

Two collections of `m` small hashes (each of `q` minhashes) stand for a document; each table key combines one hash of the first
with one of the second. So m * m tables need 2 * m * q minhashes instead of 2 * m * m * q. At a similarity of 0.8, q = 3 and m = 10
miss a pair with probability 0.0015; at 0.9 with 0.000005.

Documents with equal sets form a class. Candidates are checked on full sets in three rounds, so that a large group of near
copies costs a few comparisons a member instead of all pairs:
  1. each class with one partner, the least class (by hash) that shares a key with it;
  2. each class with the least member of every key, where the two are not yet in one component;
  3. every other pair of classes that share a key and are not in one component after that.
Rounds 1 and 2 leave out pairs that a sketch of 256 bins finds implausible; that only orders the work, as round 3 meets them again.
Round 3 groups classes by their hashes of the first collection (a pair by its first common one). Members of a group's
largest component are compared with all others, never with each other; a group of more than ROWS classes or ELEMENTS shingles is
cut into blocks, and each pair of blocks is one bounded task step. A first step keeps the classes that have a partner in their block which
shares a table key and whose sketch comes within six standard deviations of the threshold (a loss of one true pair at the threshold in 10^9); a
second intersects the full sets of those. What leaves a block is at most one edge a component, never a pair. So work stays
in proportion to a group's size where its members are linked, and comparisons (not rows) grow with the square of the number of components
where they aren't.

A node is a row's doc_id and text, so rows that share a doc_id but not the text are told apart; a class has the least doc_id among
its rows. Texts without words have an empty set and link with nothing; texts with fewer than n words have one shingle. Rows without a doc_id
link with nothing and are kept. Very long texts are one set each, of eight bytes a shingle. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import ascii_words, columns, discard, few_parts, free_name, id_of, in_worker, materialize, mix, row_key, whole_groups, word_hashes
from changeloom.llm.components import components

Q, M, BINS = 3, 10, 256
#: The most classes, and shingles, of a block in round three.
ROWS, ELEMENTS = 1024, 1 << 21
#: Vocabulary columns of a block handled at a time.
WIDE = 4096
_ONES = np.uint64(0x1111111111111111)  # the lowest bit of every four
_RNG = np.random.default_rng(20240229)
_MUL = _RNG.integers(1, 2**63, 2 * M * Q, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, 2 * M * Q, dtype=np.uint64)


def shingle_sets(text: pa.Array, n: int) -> list[np.ndarray]:
    """Of every text the sorted distinct 64-bit hashes of its n-word shingles; of fewer words one for the whole sequence."""
    codes, words, lens = ascii_words(text)
    if not len(codes):
        return [np.zeros(0, np.uint64)] * len(text)
    h = word_hashes(words)
    rolled = np.zeros(len(codes), np.uint64)
    for k in range(n):
        part = mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        rolled[: len(codes) - k] += part[codes[k:]]
    rolled = mix(rolled)
    out, at = [], 0
    for size in lens.tolist():
        if size >= n:
            out.append(np.unique(rolled[at : at + size - n + 1]))
        elif size:
            one = np.full(1, size, np.uint64)
            for c in codes[at : at + size].tolist():
                one = mix(one + h[c : c + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def half_keys(sets: list[np.ndarray]) -> np.ndarray:
    """2 * M hashes of Q minhashes each, for every set that isn't empty."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), 2 * M), np.uint64)
    for k in range(2 * M * Q):
        least = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], starts)
        out[:, k // Q] = mix(out[:, k // Q] + mix(least))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """BINS numbers of four bits for every sorted set: 0 for a bin without a hash, else 1 to 15 by the least hash in it."""
    out = np.zeros((len(sets), BINS), np.uint64)
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
    for k, s in enumerate(sets):
        at = np.minimum(np.searchsorted(s, edges), len(s) - 1)
        out[k] = np.where((s[at] >> np.uint64(56)) == np.arange(BINS, dtype=np.uint64), (s[at] >> np.uint64(16)) % np.uint64(15) + np.uint64(1), np.uint64(0))
    shift = np.arange(16, dtype=np.uint64) * np.uint64(4)
    return np.bitwise_or.reduce(out.reshape(len(sets), BINS // 16, 16) << shift, axis=2) if len(sets) else np.zeros((0, BINS // 16), np.uint64)


def plausible(a: str, b: str, percent: int) -> str:
    """SQL: whether two sketches agree in as many bins as those of similar sets do, less four standard deviations."""
    t, ones = percent / 100, "1229782938247303441L"  # the lowest bit of every four
    low = lambda z: f"(({z} | shiftrightunsigned({z}, 1) | shiftrightunsigned({z}, 2) | shiftrightunsigned({z}, 3)) & {ones})"
    used = f"transform(zip_with({a}, {b}, (x, y) -> x | y), z -> {low('z')})"
    other = f"transform(zip_with({a}, {b}, (x, y) -> x ^ y), z -> {low('z')})"
    n = f"aggregate({used}, 0, (s, z) -> s + bit_count(z))"
    same = f"aggregate(zip_with({used}, {other}, (u, o) -> u & ~o), 0, (s, z) -> s + bit_count(z))"
    return f"{same} >= {t} * {n} - {4 * (t * (1 - t)) ** 0.5} * sqrt({n})"


def plausible_rows(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """plausible() for rows of sketches, within six standard deviations."""
    low = lambda z: (z | z >> np.uint64(1) | z >> np.uint64(2) | z >> np.uint64(3)) & _ONES
    used = low(a | b)
    n = np.bitwise_count(used).sum(axis=1).astype(float)
    same = np.bitwise_count(used & ~low(a ^ b)).sum(axis=1)
    t = percent / 100
    return same >= t * n - 6 * np.sqrt(t * (1 - t) * n)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """Of rows (node, text): node, n, digest (d1, d2) of the set, both collections of small hashes and the sketch (none for empty sets)."""
    schema = T.StructType([T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("half", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for ids, text in columns(batches, "node", "text"):
            sets = shingle_sets(text, n)
            size = np.array([len(s) for s in sets], np.int64)
            full = [s for s in sets if len(s)]
            half = half_keys(full).view(np.int64) if full else np.zeros((0, 2 * M), np.int64)
            ends = np.concatenate([[0], np.cumsum(np.where(size > 0, 2 * M, 0))]).astype(np.int32)
            bins = pa.ListArray.from_arrays(pa.array((ends // (2 * M) * BINS // 16).astype(np.int32)), pa.array(sketches(full).view(np.int64).reshape(-1)))
            digest = [xxh3_128_intdigest(s.tobytes()) for s in sets]
            d1, d2 = (np.array([(d >> k) & (2**64 - 1) for d in digest], np.uint64).view(np.int64) for k in (0, 64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(pa.array(ends), pa.array(half.reshape(-1))), bins], names=[f.name for f in schema])

    return docs.select("node", "text").mapInArrow(run, schema)


def keys(classes: DataFrame) -> DataFrame:
    """A row (key, d1, n) for each of a class's M * M table keys. Here 64 bits name a class: more candidates if two share them, none less."""
    each = F.transform(F.sequence(F.lit(0), F.lit(M * M - 1)), lambda k: F.xxhash64(k, F.col("half")[(k / M).cast("int")], F.col("half")[k % M + M]))
    return classes.select(F.explode(each).alias("key"), "d1", "n")


def full_sets(docs: DataFrame, wanted: DataFrame, n: int, total: int) -> DataFrame:
    """(node, set) for the wanted nodes, written once: the sorted 64-bit hashes as bytes. The wanted grow with the input, so they aren't broadcast."""

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, text in columns(batches, "node", "text"):
            yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in shingle_sets(text, n)], pa.binary())], names=["node", "set"])

    some = docs.join(wanted.select("node").distinct().hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    out = materialize(few_parts(some, total).mapInArrow(run, "node binary, set binary"), "sets")
    free_disk(docs)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, x, y) the distinct (x, y) whose sets at a and b have 100 * intersection >= percent * union."""
    left, right = (sets.select(F.col("node").alias(side), F.col("set").alias(f"set_{side}")) for side in ("a", "b"))

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(2), b.column(3), strict=True):
                s, t = (np.frombuffer(x.as_buffer(), np.uint64) for x in (s, t))
                both = len(s) + len(t) - len(np.union1d(s, t))
                keep.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("x", "y", "set_a", "set_b")
    return joined.mapInArrow(run, "a binary, b binary").distinct()


def free_disk(df: DataFrame) -> None:
    """Shuffle files go when the JVM collects its garbage; after a large step that is asked for."""
    df.sparkSession._jvm.System.gc()


def labelled(df: DataFrame, found: DataFrame, node: str, label: str) -> DataFrame:
    """df with the component of a node, the node itself where it has none."""
    at = found.select(F.col("node").alias("_at"), F.col("component").alias("_in"))
    return df.join(at, F.col(node) == F.col("_at"), "left").withColumn(label, F.coalesce("_in", node)).drop("_at", "_in")


GROUP = ["i", "h", "lo", "hi"]


def blocks(met: DataFrame, total: int) -> DataFrame:
    """Rows (i, h, c, rep, n, ...) of groups with more than one component, dealt to pairs of blocks: with block, lo and hi added.

    A group of up to ROWS rows is one block. In a larger one the rows of its largest component have blocks of their own, which meet all
    blocks of the other rows but not each other."""
    parts = met.groupBy("i", "h", "c").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    layout = parts.groupBy("i", "h").agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.max(F.struct("k", "s", "c")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    many = lambda k, s: F.ceil(F.greatest(k / ROWS, s / ELEMENTS)).cast("int")
    one = (F.col("k") <= ROWS) & (F.col("s") <= ELEMENTS)
    layout = layout.select("i", "h", F.col("most.c").alias("large"), F.when(one, 1).otherwise(many(F.col("k") - F.col("most.k"), F.col("s") - F.col("most.s"))).alias("others"), F.when(one, 0).otherwise(many(F.col("most.k"), F.col("most.s"))).alias("own"))
    layout = materialize(few_parts(layout, total), "layout")
    inside = (F.col("c") == F.col("large")) & (F.col("own") > 0)
    deal = lambda most: F.pmod(F.xxhash64("rep"), most).cast("int")
    dealt = met.join(layout, ["i", "h"]).withColumn("block", F.when(inside, F.col("others") + deal(F.greatest("own", F.lit(1)))).otherwise(deal(F.col("others"))))
    dealt = dealt.withColumn("meets", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("own")) - 1)))
    out = dealt.withColumn("lo", F.least("block", "meets")).withColumn("hi", F.greatest("block", "meets")).drop("meets", "large", "others", "own")
    out._layout = layout
    return out


def grouped(df: DataFrame) -> DataFrame:
    return df.repartition(*GROUP).sortWithinPartitions(*GROUP, "rep")


def asking(dealt: DataFrame, percent: int) -> DataFrame:
    """The rows of dealt() that have a candidate in their group: another component, a common table key, alike in size and sketch."""
    names = [*GROUP, "block", "rep", "c", "n"]

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, GROUP):
            i, block, n, apart = (rows[c].to_numpy() for c in ("i", "block", "n", "lo"))
            apart = apart != rows["hi"].to_numpy()
            c = rows["c"].combine_chunks().dictionary_encode().indices.to_numpy()
            half = rows["half"].combine_chunks().flatten().to_numpy().reshape(len(n), 2 * M)
            sketch = rows["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(n), BINS // 16)
            hit, x, k = np.zeros(len(n), bool), np.arange(len(n)), 0
            while len(x):  # every row with the k-th row after it, as long as that is in the same group
                k += 1
                x = x[x + k < len(n)]
                x = x[group[x] == group[x + k]]
                a = x[(c[x] != c[x + k]) & (100 * np.minimum(n[x], n[x + k]) >= percent * np.maximum(n[x], n[x + k])) & ~(apart[x] & (block[x] == block[x + k]))]
                a = a[(half[a, M:] == half[a + k, M:]).any(axis=1)]
                a = a[(half[a, :M] == half[a + k, :M]).argmax(axis=1) == i[a]]
                a = a[plausible_rows(sketch[a], sketch[a + k], percent)]
                hit[a] = hit[a + k] = True
            yield from rows.select(names).filter(pa.array(hit)).to_batches()

    return grouped(dealt).mapInArrow(run, "i int, h long, lo int, hi int, block int, rep binary, c binary, n long")


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at left with those at right, through values that stand in several sets."""
    size = np.array([len(s) for s in sets])
    _, value, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), count > 1
    keep = shared[value]
    row, value = row[keep], (np.cumsum(shared) - 1)[value[keep]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(value, kind="stable")
    row, value = row[order], value[order]
    for at in range(0, int(shared.sum()), WIDE):
        a, z = np.searchsorted(value, [at, at + WIDE])
        one = np.zeros((len(sets), WIDE), np.float32)
        one[row[a:z], value[a:z] - at] = 1
        out += one[left] @ one[right].T
    return out


def linked(asked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the components of asking()'s rows, at most one a component and group, by their full sets."""

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, GROUP):
            block, n, lo, hi = (rows[c].to_numpy() for c in ("block", "n", "lo", "hi"))
            code = rows["c"].combine_chunks().dictionary_encode()
            c, out = code.indices.to_numpy(), []
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"].combine_chunks()]
            ends = [*np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist(), len(group)]
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                at = np.arange(z - a)
                left, right = (at, at) if lo[a] == hi[a] else (np.flatnonzero(block[a:z] == lo[a]), np.flatnonzero(block[a:z] == hi[a]))
                if not len(left) or not len(right):
                    continue
                both = intersections(sets[a:z], left, right).astype(np.int64)
                own = n[a:z]
                x, y = np.nonzero((100 * both >= percent * (own[left][:, None] + own[right][None, :] - both)) & (both > 0))
                x, y = c[a:z][left[x]], c[a:z][right[y]]
                pair = np.unique(np.stack([x, y], axis=1)[x != y], axis=0)
                up = dict(zip(pair.reshape(-1).tolist(), pair.reshape(-1).tolist(), strict=True))
                for x, y in pair.tolist():
                    while up[x] != x:
                        x = up[x]
                    while up[y] != y:
                        y = up[y]
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        out.append((x, y))
            if out:
                yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(side)) for side in zip(*out, strict=True)], names=["a", "b"])

    joined = asked.join(sets.withColumnRenamed("node", "rep"), "rep")
    return grouped(joined).mapInArrow(run, "a binary, b binary")


def near_rows(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each of docs: node (null without a doc_id), n (size of its set), root (the least node that can be reached)."""
    docs = docs.select(row_key(id_col, text_col).alias("node"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, n), "signatures")
    total = signed.count()
    put = lambda df, name: materialize(few_parts(df, total), name)
    classes = put(signed.where("n > 0 and node is not null").groupBy("d1", "d2").agg(F.min("node").alias("rep"), F.first("n").alias("n"), F.first("half").alias("half"), F.first("sketch").alias("sketch")), "classes")

    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)  # noqa: E731  no pair of other sizes is similar
    rows = keys(classes)
    hubs = rows.groupBy("key").agg(F.min(F.struct("d1", "n")).alias("hub"), F.count("*").alias("size")).where("size > 1")
    met = rows.join(hubs, "key").where("d1 <> hub.d1")
    shared = met.select("d1", F.col("hub.d1").alias("k_b"), alike(F.col("n"), F.col("hub.n")).alias("near")).distinct()
    shared = put(shared, "shared")
    free_disk(docs)
    twice = classes.groupBy("d1").count().where("count > 1").select("d1")  # classes with one 64-bit name, which meet in round three
    meeting = shared.select(F.explode(F.array("d1", "k_b")).alias("d1")).unionByName(twice).distinct()
    meeting = classes.join(meeting, "d1", "left_semi")  # the classes that share a key with any other
    sets = full_sets(docs, meeting.select(F.col("rep").alias("node")), n, total)
    side = lambda x: classes.select(F.col("d1").alias(f"k_{x}"), F.col("rep").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    pairs = shared.where("near and d1 > k_b").select(F.col("d1").alias("k_a"), "k_b").join(side("a"), "k_a").join(side("b"), "k_b")
    pairs = put(pairs.where(plausible("sketch_a", "sketch_b", percent)).select("a", "b", "k_b"), "pairs")

    first = pairs.groupBy("a").agg(F.min_by("b", "k_b").alias("b"))
    links = put(verified(first.select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")), sets, percent), "links")
    found = components(links)
    apart = labelled(labelled(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"), found, "a", "x"), found, "b", "y").where("x <> y")
    links2 = put(verified(apart, sets, percent), "links")
    found2 = components(links2)
    free_disk(docs)

    marked = labelled(labelled(meeting, found, "rep", "c1"), found2, "c1", "c").drop("c1")
    dealt = blocks(marked.select(F.posexplode(F.slice("half", 1, M)).alias("i", "h"), "rep", "n", "c", "half", "sketch"), total)
    asked = materialize(asking(dealt, percent), "asked")
    free_disk(docs)
    links3 = materialize(linked(asked, sets, percent), "links")
    found3 = components(links3)

    member = labelled(labelled(labelled(classes.select("d1", "d2", "rep"), found, "rep", "c1"), found2, "c1", "c"), found3, "c", "root").select("d1", "d2", "root")
    out = signed.select("node", "n", "d1", "d2").join(member, ["d1", "d2"], "left")
    root = F.when((F.col("n") > 0) & F.col("node").isNotNull(), F.col("root")).otherwise(F.col("node"))
    out = put(out.select("node", "n", root.alias("root")), "near")
    discard(signed, classes, shared, pairs, sets, links, found, links2, found2, dealt._layout, asked, links3, found3)
    free_disk(docs)
    return out


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept."""
    doc_id, c = id_of("node"), id_of("root")
    return near_rows(docs, n, percent, id_col, text_col).select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), c.alias("component_id"), F.coalesce(c == doc_id, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents, one of each group; columns as given. Of rows that repeat doc_id and text the one with the least other columns (as JSON)
    stays; rows without a doc_id and rows without words all stay."""
    rows = near_rows(docs, n, percent, "doc_id", "text")
    kept = rows.where("node = root").groupBy("node").agg(F.count("*").alias("copies"), F.max("n").alias("n"))
    kept = kept.withColumn("again", F.expr("copies > 1 and n > 0"))
    total = rows.count()
    single, several = (materialize(few_parts(kept.where(which).select("node"), total), "kept") for which in ("not again", "again"))
    key = free_name(docs, "node")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    of = lambda nodes: keyed.join(nodes.withColumnRenamed("node", key), key, "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = of(several).groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*others)) if others else F.lit(0)).alias("row"))
    discard(rows)
    return of(single).select(*docs.columns).unionByName(least.select("row.*")).unionByName(docs.where("doc_id is null"))
