"""Operator 2: substring dedup by hashing lines and paragraphs, and long runs of words wherever they begin.

A text is cut into units: lines, and within lines the stretches that begin with an upper-case letter after a space or follow
the end of a sentence. A paragraph is a run of consecutive units with at least `min_words` words, the shortest that starts (or
that ends) at a given unit; so every passage that begins and ends with a unit is covered by paragraphs, wherever it stands.
Paragraphs are normalised (lower case, single spaces) and hashed; digests are grouped over all documents; the occurrence of
the lowest rank (doc_id, then position) stays and every unit of the later ones is removed, with the line break after it when its
line is gone. The offsets of what was removed are kept, in characters of the original text.

Besides, every run of LONG words that stands earlier is removed, without regard to units. The sketch of such a run is the least hash
of its runs of ANCHOR words, so neighbouring runs mostly have one sketch, and equal runs have equal ones. Sketches are grouped over
all documents first; then only runs whose sketch repeats are hashed in full and grouped, each by itself; so passages of LONG words and
more go up to their edges. Where paragraphs took a part of one, what is left at its sides goes if it has EDGE words. An occurrence that
overlaps the first one in the same document is no repeat of it.

Within a batch only the first occurrence of a digest enters the shuffle, and later ones are known as repeats at once; so a
passage that stands in a third of all documents gives at most one row a batch.

Null and empty texts stay as they are. Rows that share a doc_id are told apart by a number (twins()), by which they are ranked after the
doc_id, so a row that is repeated keeps one copy of its passages. Rows without a doc_id are left alone. Very long texts are handled in a
batch of their own. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import coded, columns, discard, few_parts, free_name, in_worker, materialize, mix, word_hashes

MIN_WORDS = 30
LONG, ANCHOR, EDGE = 51, 26, 5
#: A span is begin << 32 | end where it is one number.
LOW = 0xFFFFFFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ENDS = (".", "!", "?", "…", "。", "！", "？")


def words_of(text: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between spaces and line breaks, a line break being a word; codes, distinct words, words per text. Empty words are runs of spaces."""
    lines = pc.replace_substring(text.fill_null(""), "\n", " \n ")
    return coded(pc.split_pattern(lines, " "))


def word_facts(words: pa.Array) -> tuple[np.ndarray, ...]:
    """Of distinct words: the hash of the normalised word, whether it is more than white space, a line break, ends a sentence, begins with an
    upper-case letter, and its length in characters (a line break has 0). ASCII words without control characters are told by their bytes, all at once."""
    words = words.cast(pa.string())
    off = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off -= off[0]
    size = np.diff(off)
    real = size > 0
    odd = np.diff(np.concatenate([[0], np.cumsum((data <= 32) | (data >= 128))])[off]) > 0
    head, tail = np.zeros(len(words), np.uint8), np.zeros(len(words), np.uint8)
    head[real], tail[real] = data[off[:-1][real]], data[off[1:][real] - 1]
    upper, stop, brk = (head >= 65) & (head <= 90), np.isin(tail, np.frombuffer(b".!?", np.uint8)), np.zeros(len(words), bool)
    folded = pc.ascii_lower(words)
    if odd.any():
        at = np.flatnonzero(odd)
        said = words.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist()
        real[at], brk[at] = [bool(w.strip()) for w in said], [w == "\n" for w in said]
        stop[at], upper[at] = [w.endswith(_ENDS) for w in said], [w[:1].isupper() for w in said]
        size[at] = [0 if w == "\n" else len(w) for w in said]
        folded = pc.replace_with_mask(folded, pa.array(odd), pa.array([" ".join(w.lower().split()) for w in said], pa.string()))
    return mix(word_hashes(folded)), real, brk, stop, upper, size


class Units:
    """Units and paragraph digests of a batch of texts."""

    def __init__(self, text: pa.Array, min_words: int):
        codes, words, lens = words_of(text)
        h, real, brk, stop, upper, size = word_facts(words)
        real_of = real[codes] if len(codes) else np.zeros(0, bool)
        at = np.flatnonzero(real_of)  # the words proper, by place in the batch
        doc = np.repeat(np.arange(len(lens)), lens)[at]
        c = codes[at]
        broken = np.zeros(len(codes) + 1, np.int64)
        broken[1:] = np.cumsum(brk[codes]) if len(codes) else 0
        line = broken[at]
        start = np.ones(len(at), bool)
        start[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1]) | stop[c[:-1]] | upper[c[1:]]
        #: Characters from the text's start to each word: lengths and one for each space; " \n " stands for one character.
        width = size[codes] + 1 if len(codes) else np.zeros(0, np.int64)
        if len(codes):
            is_brk = brk[codes]
            width[is_brk] = 0  # " \n ": the space before it counts as the line break, that after it as nothing
        ends = np.concatenate([[0], np.cumsum(width)])
        first_word = np.cumsum(lens) - lens
        self.unit = np.flatnonzero(start)
        self.doc = doc[self.unit]
        stopw = np.append(self.unit[1:], len(at))[: len(self.unit)]  # no unit: no border either
        self.words = stopw - self.unit
        self.begin = ends[at[self.unit]] - ends[first_word[self.doc]]
        last = at[stopw - 1]
        self.end = ends[last] + (size[codes[last]] if len(codes) else 0) - ends[first_word[self.doc]]
        # Prefix sums of powers make the digest of any run of words: sum of h * STEP^k, scaled back by its own start.
        power = np.ones(len(at) + 1, np.uint64)
        if len(at):
            power[1:] = np.multiply.accumulate(np.full(len(at), _STEP, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h[c] * power[:-1], dtype=np.uint64)])
        inverse = np.ones(len(at) + 1, np.uint64)
        if len(at):
            inverse[1:] = np.multiply.accumulate(np.full(len(at), np.uint64(pow(int(_STEP), -1, 2**64)), np.uint64))
        self.total, self.inverse = total, inverse
        #: Of each word its text and its place there, in characters.
        self.word_doc = doc
        self.word_begin = ends[at] - ends[first_word[doc]]
        self.word_end = self.word_begin + (size[c] if len(c) else 0)
        count = np.concatenate([[0], np.cumsum(self.words)])  # words up to each unit
        n = len(self.unit)
        docs_end = np.searchsorted(self.doc, self.doc, side="right")
        docs_start = np.searchsorted(self.doc, self.doc, side="left")
        to = np.searchsorted(count, count[:-1] + min_words, side="left")  # first unit border with enough words after the start
        fore = np.flatnonzero(to <= docs_end)
        since = np.searchsorted(count, count[1:] - min_words, side="right") - 1
        back = np.flatnonzero((since >= docs_start) & (count[1:] >= min_words))
        lo, hi = np.concatenate([fore, since[back]]), np.concatenate([to[fore], back + 1])
        run = np.unique(lo.astype(np.int64) * (n + 1) + hi)  # paragraphs as [lo, hi) of units
        self.lo, self.hi = run // (n + 1), run % (n + 1)
        a, z = count[self.lo], count[self.hi]
        self.digest = mix(mix((total[z] - total[a]) * inverse[a]) + (z - a).astype(np.uint64)).view(np.int64)

    def runs(self, n: int) -> np.ndarray:
        """Digests of the runs of n words, by their first word; those at the end of a text go on in the next one."""
        k = max(0, len(self.word_doc) - n + 1)
        return mix(mix((self.total[n : n + k] - self.total[:k]) * self.inverse[:k]) + np.uint64(n))

    def long_runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all runs of LONG words inside one text, and their sketches."""
        least, width, want = self.runs(ANCHOR), 1, LONG - ANCHOR + 1
        while width < want:
            step = min(width, want - width)
            least, width = np.minimum(least[: max(0, len(least) - step)], least[step:]), width + step
        at = np.flatnonzero(self.word_doc[: len(least)] == self.word_doc[LONG - 1 : LONG - 1 + len(least)])
        return at, least[at].view(np.int64)


def twins(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, text): row is 0, or for rows that share a doc_id their place in the table, so (doc_id, row) names a row.

    Places hold for a table that is read in one order each time; another plan is written first."""
    found = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).count().where("count > 1 and doc_id is not null")
    twice = materialize(found.select("doc_id"), "twice")
    named = docs.select("*", F.col(id_col).cast("long").alias(key := free_name(docs, "doc_id_")), F.monotonically_increasing_id().alias(row := free_name(docs, "row_")))
    if twice.isEmpty():
        named = named.withColumn(row, F.lit(0).cast("long"))
    else:
        named = named.join(twice.select(F.col("doc_id").alias(at := free_name(docs, "twice_"))), F.col(key) == F.col(at), "left")
        named = named.withColumn(row, F.when(F.col(at).isNotNull(), F.col(row)).otherwise(0)).drop(at)
    named._names = key, row
    return named


def read_alike(docs: DataFrame) -> bool:
    """Whether the plan only reads files and computes columns, so that each reading gives the rows in one order."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    while nodes:
        node = nodes.pop()
        if node.nodeName() not in ("Project", "Filter") and not node.nodeName().startswith("LogicalRelation") and not node.nodeName().startswith("Relation"):
            return False
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return True


def sketches(docs: DataFrame) -> DataFrame:
    """(sketch, doc_id, row, key, more): the first of each sketch in a batch has it as key, with more set if the batch has others; those have a key of their own."""

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, text in columns(batches, "doc_id", "row", "text"):
            u = Units(text, MIN_WORDS)
            at, sketch = u.long_runs()
            if not len(at):
                continue
            # Runs with one anchor in common; more than there can be hold equal anchors.
            new = np.append(True, (sketch[1:] != sketch[:-1]) | (at[1:] != at[:-1] + 1))
            first = np.flatnonzero(new)
            long = np.diff(np.append(first, len(at))) > LONG - ANCHOR + 1
            of, sketch = u.word_doc[at[first]], sketch[first]
            order = np.lexsort((of, sketch))
            sketch, of, long = sketch[order], of[order], long[order]
            again = np.append(False, sketch[1:] == sketch[:-1])
            head = np.flatnonzero(~again)
            more = np.zeros(len(sketch), bool)
            more[head] = np.logical_or.reduceat(again | long, head)
            doc_id, row = (x.to_numpy(zero_copy_only=False)[of] for x in (ids, rows))
            own = mix(mix(mix(sketch.view(np.uint64)) + doc_id.astype(np.uint64)) + row.astype(np.uint64)).view(np.int64)
            once = ~again | np.append(True, (sketch[1:] != sketch[:-1]) | (of[1:] != of[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (sketch, doc_id, row, np.where(again, own, sketch), more | again)], names=["sketch", "doc_id", "row", "key", "more"])

    return docs.mapInArrow(run, "sketch long, doc_id long, row long, key long, more boolean")


def long_repeats(docs: DataFrame, total: int) -> DataFrame:
    """Of rows (doc_id, row, text): (doc_id, row, runs): runs of LONG words that repeat an occurrence of lower rank, joined where they overlap, as [begin, end) offsets in characters."""
    by = W.partitionBy("key")
    rows = sketches(docs)
    rows = rows.withColumn("n", F.count("*").over(by)).withColumn("any", F.max("more").over(by)).where("n > 1 or any")
    wanted = materialize(few_parts(rows.groupBy("doc_id", "row").agg(F.collect_set("sketch").alias("sketches")), total), "sketches")
    docs.sparkSession._jvm.System.gc()
    some = docs.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "sketches", "text")

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, wanted, text in columns(batches, "doc_id", "row", "sketches", "text"):
            u = Units(text, MIN_WORDS)
            at, sketch = u.long_runs()
            at = at[np.isin(sketch, wanted.flatten().to_numpy(zero_copy_only=False))]
            if not len(at):
                continue
            digest = u.runs(LONG)[at].view(np.int64)
            ids, rows = (x.to_numpy(zero_copy_only=False) for x in (ids, rows))
            doc_id, row_of = ids[u.word_doc[at]], rows[u.word_doc[at]]
            begin, end = u.word_begin[at], u.word_end[at + LONG - 1]
            order = np.lexsort((begin, row_of, doc_id, digest))
            d, doc_id, row_of, begin, end = digest[order], doc_id[order], row_of[order], begin[order], end[order]
            same = np.append(False, d[1:] == d[:-1])
            head = np.maximum.accumulate(np.where(same, 0, np.arange(len(d))))
            again = same & ((doc_id != doc_id[head]) | (row_of != row_of[head]) | (begin >= end[head]))
            # Runs that repeat one of the batch are known at once and joined; the others keep the order of the texts, which packs better.
            text_of, at, to = joined_runs(u.word_doc[at][order][again], begin[again], end[again])
            late = ids[text_of]
            own = mix(mix(late.astype(np.uint64)) + mix(rows[text_of].astype(np.uint64)) + at.astype(np.uint64)).view(np.int64)
            rest = np.flatnonzero(~again)
            rest = rest[np.argsort(order[rest])]
            parts = ((d[rest], own), (doc_id[rest], late), (row_of[rest], rows[text_of]), (begin[rest] << 32 | end[rest], at << 32 | to), (again[rest], np.ones(len(late), bool)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=["digest", "doc_id", "row", "span", "again"])

    by = W.partitionBy("digest").orderBy("again", "doc_id", "row", "span")
    rows = some.mapInArrow(run, "digest long, doc_id long, row long, span long, again boolean")
    rows = rows.withColumn("place", F.row_number().over(by)).withColumn("first", F.first(F.struct("doc_id", "row", "span")).over(by))
    rows = rows.where(f"again or place > 1 and (doc_id <> first.doc_id or row <> first.row or shiftright(span, 32) >= first.span & {LOW})")

    @in_worker
    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = b.column(2)
            size = pc.list_value_length(spans).to_numpy(zero_copy_only=False)
            span = spans.flatten().to_numpy(zero_copy_only=False)
            row, begin, end = joined_runs(np.repeat(np.arange(len(size)), size), span >> 32, span & LOW)
            runs = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=["begin", "end"])
            ends = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends), runs)], names=["doc_id", "row", "runs"])

    grouped = rows.groupBy("doc_id", "row").agg(F.collect_list("span").alias("spans"))
    out = materialize(few_parts(grouped, total).mapInArrow(joined, "doc_id long, row long, runs array<struct<begin:int,end:int>>"), "runs")
    discard(wanted)
    docs.sparkSession._jvm.System.gc()
    return out


def joined_runs(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the spans, those of a row that overlap or touch made one."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order].astype(np.int64), begin[order].astype(np.int64), end[order].astype(np.int64)
    far = np.maximum.accumulate(row << 32 | end) & LOW  # the furthest end so far in the same row
    new = np.append(True, (row[1:] != row[:-1]) | (begin[1:] > far[:-1] + 1))[: len(row)]
    first = np.flatnonzero(new)
    return row[first], begin[first], far[np.append(first[1:], len(row)) - 1] if len(row) else end


def with_sides(text: str, spans: list[tuple[int, int]], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, and of each run what they leave: all if they touch nothing of it, else pieces of at least EDGE words."""
    more = []
    for begin, end in runs:
        inside = [(a, z) for a, z in spans if a < end and z > begin]
        at = begin
        for a, z in [*inside, (end, end)]:
            piece = text[at : max(at, a)]
            if said := piece.strip(" \n"):
                if not inside or len(said.split()) >= EDGE:
                    lead = len(piece) - len(piece.lstrip(" \n"))
                    more.append((at + lead, at + lead + len(said)))
            at = max(at, z)
    return merged(spans + more) if more else spans


def paragraphs(docs: DataFrame, min_words: int) -> DataFrame:
    """(digest, doc_id, row, begin, end, again): the first of each digest in a batch; later ones with again set and a digest of their own."""
    schema = T.StructType([T.StructField("digest", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("again", T.BooleanType())])

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, text in columns(batches, "doc_id", "row", "text"):
            u = Units(text, min_words)
            if not len(u.lo):
                continue
            doc_id, row = (x.to_numpy(zero_copy_only=False)[u.doc[u.lo]] for x in (ids, rows))
            begin, end = u.begin[u.lo], u.end[u.hi - 1]
            order = np.lexsort((begin, row, doc_id, u.digest))
            d, doc_id, row, begin, end = u.digest[order], doc_id[order], row[order], begin[order], end[order]
            again = np.append(False, d[1:] == d[:-1])
            own = mix((doc_id.astype(np.uint64) << np.uint64(24)) + mix(row.astype(np.uint64)) + begin.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(again, own, d)), pa.array(doc_id), pa.array(row), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(again)], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Of rows (doc_id, row, text): (doc_id, row, spans): paragraphs that repeat an occurrence of lower rank, as [begin, end) offsets in characters; they may overlap."""
    rows = paragraphs(docs, min_words)
    by = W.partitionBy("digest").orderBy("again", "doc_id", "row", "begin")
    rows = rows.withColumn("place", F.row_number().over(by)).where("again or place > 1")
    return rows.groupBy("doc_id", "row").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint spans; those that touch or have one character between them become one."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space that a removal leaves doubled or at an edge goes with it."""
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at:begin])
        at = end
        left = out[-1][-1:] if out[-1] else ("" if len(out) > 1 else "\n")
        while at < len(text) and text[at] in " \n" and (left in ("\n", "") or text[at] == " " and left == " "):
            at += 1
            if text[at - 1] == "\n":
                break
    out.append(text[at:])
    return "".join(out)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", spans_col: str | None = "removed") -> DataFrame:
    """docs with repeats removed from text_col and, in spans_col, the offsets of what was removed (null: nothing)."""
    docs = docs if read_alike(docs) else materialize(docs, "texts")
    named = twins(docs, id_col, text_col)
    key, row = named._names
    texts = named.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    total = docs.count()
    long = long_repeats(texts, total)
    found = materialize(few_parts(repeated_spans(texts, min_words).join(long, ["doc_id", "row"], "full"), total), "spans")
    discard(long)
    docs.sparkSession._jvm.System.gc()
    names = [c for c in docs.columns if c != spans_col]
    spans, runs = (free_name(docs, c) for c in ("spans_", "runs_"))
    found = found.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("spans").alias(spans), F.col("runs").alias(runs))
    joined = named.join(found, [key, row], "left").select(*names, spans, runs)
    schema = T.StructType([f for f in docs.schema.fields if f.name != spans_col] + ([T.StructField(spans_col, found.schema[spans].dataType)] if spans_col else []))
    place = names.index(text_col)

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, long = b.column(len(names)), b.column(len(names) + 1)
            text = b.column(place)
            if spans.null_count < len(spans) or long.null_count < len(long):
                pairs = lambda s: merged([(x["begin"], x["end"]) for x in s or []])
                runs = [None if t is None or s is None and more is None else with_sides(t, pairs(s), pairs(more)) for t, s, more in zip(text.to_pylist(), spans.to_pylist(), long.to_pylist(), strict=True)]
                text = pa.array([t if s is None or t is None else cut(t, s) for t, s in zip(text.to_pylist(), runs, strict=True)], text.type)
                spans = pa.array([s and [{"begin": a, "end": z} for a, z in s] for s in runs], spans.type)
            cols = [*b.columns[: len(names)]]
            cols[place] = text
            yield pa.RecordBatch.from_arrays([*cols, *([spans] if spans_col else [])], names=[f.name for f in schema])

    return joined.mapInArrow(run, schema)


def kept_text(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Pipeline form: the documents with what remains of their texts; columns as given, n_chars renewed where it exists."""
    out = remove_repeats(docs, min_words, spans_col=None)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


