"""A concurrent snapshot: chunk waves between a low and a high mark, eviction, resume, pause.

The plan is written once; every finished wave leaves a row for each of its chunks. A run that was interrupted goes on with the chunks that have
none. A wave reads its chunks in one job (a task has a part of a chunk, so chunks are copied side by side) and is published as one
batch of the target's feed "snapshot", so a wave that was published but not yet noted changes nothing when it comes again.

Rows are read somewhere between the marks, so they get the low one as position: the log's rows after it win, in whatever order both arrive.
Keys that the log changed inside the window are left out of what is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.model import INSERT
from changeloom.operators import reconcile, snapshot
from changeloom.operators.active import ActiveChunks
from changeloom.streaming.control import CDC, SNAPSHOT, Job
from changeloom.streaming.store import Files, Target


class SnapshotRun:
    """Copies one table into a target. wave: chunks that are copied at a time, few enough to be sent to every task."""

    def __init__(self, spark: SparkSession, path: str, name: str, target: Target, key: str, wave: int = 8, job: Job | None = None):
        self.spark, self.path, self.name, self.target, self.key, self.wave, self.job = spark, path, name, target, key, wave, job or Job(name)
        self.files, self.active = Files(spark, path), ActiveChunks()
        self._name(int(self.files.read("RUN") or 0))

    def _name(self, number: int) -> None:
        self.number, tail = number, f"-{number}" if number else ""
        self.plan, self.waves, self.feed = f"plan{tail}", f"wave{tail}=", f"snapshot{tail}"

    def forget(self) -> None:
        """Start over: for a source whose log begins anew, so that chunks copied before may have missed changes. One renamed file makes the plan and
        waves so far stale, and the target's batches of the next run a feed of their own; the folders go after that. Rows that went at the source with no record of it stay in
        the target."""
        old = [f for f in self.files.folders() if f.startswith(("plan", "wave"))]
        self.files.replace("RUN", str(self.number + 1))
        self._name(self.number + 1)
        for f in old:
            self.files.remove(f)

    def prepare(self, bounds: DataFrame, size: int) -> None:
        """Write the plan for a row of bounds (lo, hi, n), unless there is one: chunks keep their ranges over restarts."""
        if self.plan not in self.files.folders():
            snapshot.plan(bounds, size).write.mode("overwrite").parquet(f"{self.path}/.plan")
            self.files.rename(".plan", self.plan)

    def done(self) -> DataFrame:
        """(partition_id, start_pk, end_pk, low, hw) of the finished chunks."""
        waves = [f for f in self.files.folders() if f.startswith(self.waves)]
        kind = "partition_id long, start_pk long, end_pk long, low decimal(20,0), hw decimal(20,0)"
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{w}" for w in sorted(waves)]) if waves else self.spark.createDataFrame([], kind)

    def state(self) -> DataFrame:
        """Chunk states: (table_name, partition_id, start_pk, end_pk, status)."""
        done = self.done().select("partition_id", F.lit(snapshot.COMPLETE).alias("done"))
        plan = self.spark.read.parquet(f"{self.path}/{self.plan}").join(done, "partition_id", "left")
        return plan.select(F.lit(self.name).alias("table_name"), "partition_id", "start_pk", "end_pk", F.coalesce("done", F.lit(snapshot.PENDING)).alias("status"))

    def run(self, read: Callable[[int, int], DataFrame], mark: Callable[[], int], changes: Callable[[int, int], DataFrame] | None = None) -> int:
        """Copy all chunks that aren't complete; the number of waves. read(start, end): the table's rows of a key range as they are now; mark(): the
        log's position now; changes(low, high): log rows (key, op, pos) of a window. A paused job waits between waves, a stopped one raises."""
        self.job.stage, waves = SNAPSHOT, 0
        while chunks := self.state().where(F.col("status") != snapshot.COMPLETE).orderBy("partition_id").limit(self.wave).collect():
            self.job.check()
            number = len([f for f in self.files.folders() if f.startswith(self.waves)])
            low = mark()
            for c in chunks:
                self.active.register(self.name, c.partition_id, c.start_pk, c.end_pk, low)
            start, end = min(c.start_pk for c in chunks), max(c.end_pk for c in chunks)
            wave = self.spark.createDataFrame([(c.partition_id, c.start_pk, c.end_pk) for c in chunks], "partition_id long, start_pk long, end_pk long")
            rows = snapshot.chunk_of(snapshot.scan(read(start, end), self.key, start, end), self.key, F.broadcast(wave)).withColumn("src_table", F.lit(self.name))
            high = mark()
            for c in chunks:
                self.active.set_high(self.name, c.partition_id, high)
            if changes is not None and high > low:
                rows = reconcile.without_evicted(rows, self.active.evicted(snapshot.scan(changes(low, high), self.key, start, end).withColumn("src_table", F.lit(self.name)), self.key), self.key)
            log = rows.select(*self.target.keys, *self.target.values, F.lit(INSERT).alias("op"), F.lit(low).cast("decimal(20,0)").alias("pos"), F.lit(-1).cast("long").alias("seq"))
            self.target.apply(log, number, self.feed)
            wave.select("*", F.lit(low).cast("decimal(20,0)").alias("low"), F.lit(high).cast("decimal(20,0)").alias("hw")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/.wave")
            self.files.rename(".wave", f"{self.waves}{number:08d}")
            for c in chunks:
                self.active.deregister(self.name, c.partition_id)
            waves += 1
        self.job.stage = CDC
        return waves
