"""The streaming normaliser: micro-batches of envelope rows into targets, exactly once by batch id."""

from __future__ import annotations

import json
import time

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions.types import spark_type
from changeloom.model import DELETE, SCHEMA_CHANGE, TRUNCATE
from changeloom.operators import merge as ops
from changeloom.operators import reconcile
from changeloom.operators.schema import plan
from changeloom.streaming.control import CDC, DRAINING, STOPPED, Job, Stopped
from changeloom.streaming.store import Target


def typed_rows(log: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Envelope data rows in the columns of schema: the new image, for deletes the old one. Key-changing updates are split.

    Columns that an update names as unchanged but whose old image holds a value take it from there. An image that isn't JSON, or holds a
    value that doesn't fit its column, or lacks a key, is an error: no record is skipped."""
    data = ops.data_records(log)
    image = F.from_json(F.coalesce("after", "before"), schema, {"mode": "FAILFAST"})
    old = F.from_json("before", schema, {"mode": "FAILFAST"})
    rows = data.select("op", "pos", "seq", F.coalesce("unchanged", F.array().cast("array<string>")).alias("unchanged"), image.alias("i"), old.alias("o"), F.coalesce(F.json_object_keys("before"), F.array().cast("array<string>")).alias("told"))
    value = lambda c: F.when(F.array_contains("unchanged", c) & F.array_contains("told", c), F.col(f"o.{c}")).otherwise(F.col(f"i.{c}")).alias(c)
    lacking = F.raise_error(F.concat(F.lit("an image without a key at position "), F.coalesce(F.col("pos").cast("string"), F.lit("?"))))
    checked = {f.name: value(f.name) if f.name not in keys else F.coalesce(value(f.name), lacking.cast(f.dataType)).alias(f.name) for f in schema.fields}
    rows = rows.select("op", "pos", "seq", F.array_except("unchanged", "told").alias("unchanged"), *checked.values(), *[F.when(F.col("op") != DELETE, F.col(f"o.{k}")).alias(f"before_{k}") for k in keys])
    return ops.split_key_changes(rows, keys)


class Normalizer:
    """Applies batches to the targets of tracked tables ({schema.table: Target}). With finished snapshot chunks (src_table, start_pk,
    end_pk, hw), log rows that the snapshot already holds are left out."""

    def __init__(self, targets: dict[str, Target], job: Job | None = None, chunks: DataFrame | None = None):
        self.targets, self.job, self.chunks = targets, job or Job(), chunks

    def __call__(self, log: DataFrame, batch: int) -> None:
        began = time.time()
        self.job.check()
        log = log.select("src_schema", "src_table", "op", "before", "after", "unchanged", "pos", "seq", "commit_ts").persist()
        try:
            # One row a table: what the batch holds, so that steps it doesn't need start no job.
            held = lambda op: F.count_if(F.col("op") == op)
            counts = log.groupBy("src_schema", "src_table").agg(F.count("*").alias("n"), F.max("commit_ts").alias("commit"), held(SCHEMA_CHANGE).alias("changes"), held(TRUNCATE).alias("truncates")).collect()
            if any(r.truncates for r in counts):
                raise NotImplementedError("a truncated table needs a new snapshot")
            if any(r.changes for r in counts):
                self._evolve(log)
            found = {f"{r.src_schema}.{r.src_table}" if r.src_schema else r.src_table for r in counts}
            for name, target in self.targets.items():
                if name not in found:
                    continue
                schema, _, table = name.rpartition(".")
                mine = log.where((F.col("src_table") == table) & F.coalesce(F.col("src_schema") == schema, F.lit(not schema)))
                rows = typed_rows(mine, target.schema, target.keys)
                if self.chunks is not None:
                    rows = reconcile.drop_snapshotted(rows.withColumn("src_table", F.lit(name)), self.chunks, target.keys[0]).drop("src_table")
                target.apply(rows, batch)
            self.job.done(batch, sum(r.n for r in counts), max((r.commit for r in counts if r.commit), default=None), time.time() - began)
        except Exception as e:
            self.job.fail(e)
            raise
        finally:
            log.unpersist()

    def _evolve(self, log: DataFrame) -> None:
        """Columns added by the batch's schema changes, before its data. These rows are few: one a description of a table."""
        changes = log.where((F.col("op") == SCHEMA_CHANGE) & F.col("after").startswith("[")).orderBy("pos", "seq").select("src_schema", "src_table", "after").collect()
        described = [(f"{r.src_schema}.{r.src_table}" if r.src_schema else r.src_table, {c["name"]: c["type"] for c in json.loads(r.after)}) for r in changes]
        known = {n: {f.name: f.dataType.simpleString() for f in t.schema.fields} for n, t in self.targets.items()}
        for name, column, kind in plan(known, [d for d in described if d[0] in self.targets]):
            self.targets[name].add_columns([T.StructField(column, spark_type(kind))])


def start(stream: DataFrame, normalizer: Normalizer, checkpoint: str, once: bool = True):
    """Run the normaliser on a stream; once: all there is now, then stop (drain)."""
    writer = stream.writeStream.foreachBatch(normalizer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


def run(stream: DataFrame, normalizer: Normalizer, checkpoint: str, poll: float = 2.0) -> None:
    """Follow a stream until its job is stopped, in rounds that take all there is at their start; `poll` seconds lie between them. A paused job waits
    before its next batch, a stopped one ends before it. A job told to drain makes one more round, begun after it was told, and is stopped then."""
    job = normalizer.job
    job.stage = CDC
    try:
        while True:
            job.check()
            last = job.state == DRAINING
            start(stream, normalizer, checkpoint).awaitTermination()
            if last:
                job.stop()
            job.wait(poll)
    except Stopped:
        return
    except StreamingQueryException:
        if job.error is not None or job.state != STOPPED:
            raise
