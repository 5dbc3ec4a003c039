"""Connected components of a table of edges: few in one task, more by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.llm.common import discard, few_parts, in_worker, materialize

#: Up to so many edges are followed by union-find in one task; its memory is bounded by them.
FEW = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): component is the least node that can be reached. Edges are read twice.

    Each star step joins the edges with each node's least neighbour; hubs are handled by partial aggregation and by joins that Spark
    may split. Every step is written to the shared folder. Loops and repeated edges do no harm."""
    n = edges.count()
    if n <= FEW:
        return materialize(followed(edges.where("a <> b").select("a", "b").coalesce(1)), "components")
    put = lambda df: materialize(few_parts(df, n), "edges")  # noqa: E731  no step makes more edges than there were
    now = put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = _state(now)
    while size[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = put(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = put(small)
        discard(now, large)
        now, before, size = small, size, _state(small)
        if size == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = materialize(few_parts(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), n), "components")
    discard(now)
    return out


def followed(edges: DataFrame) -> DataFrame:
    """components() of edges in one partition, by union-find."""
    schema = T.StructType([T.StructField(c, edges.schema["a"].dataType) for c in ("node", "component")])

    @in_worker
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                up[max(x, y)] = min(x, y)
        if up:
            nodes = list(up)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "component"])

    return edges.mapInArrow(run, schema)


def _state(edges: DataFrame) -> tuple[int, int, int]:
    """Equal for equal sets of edges: their number and two sums of hashes."""
    h = F.xxhash64("a", "b")
    r = edges.agg(F.count("*").alias("n"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("s"), F.sum(F.shiftrightunsigned(h, 32)).alias("t")).first()
    return r.n, r.s or 0, r.t or 0
