"""Sinks by name. A sink takes the micro-batches of a stream; a batch may come twice and must then change nothing."""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.errors import ConfigError, SinkError
from changeloom.operators import merge as ops
from changeloom.operators import raw
from changeloom.streaming.control import DEFAULT_BATCH, DEFAULT_INTERVAL_MS
from changeloom.streaming.normalize import Normalizer
from changeloom.streaming.store import Files, Target


@dataclass(frozen=True)
class Capabilities:
    upsert: bool
    delete: bool
    evolution: bool
    transactions: bool
    max_batch: int = DEFAULT_BATCH
    flush_ms: int = DEFAULT_INTERVAL_MS


@dataclass
class Result:
    records: int
    last_position: int | None
    skipped: int = 0


class Sink(ABC):
    name = ""
    capabilities = Capabilities(False, False, False, False)

    def validate(self) -> None:
        """Raise if the sink can't be used."""

    def setup(self) -> None:
        """Prepare targets."""

    @abstractmethod
    def write(self, log: DataFrame, batch: int) -> Result:
        """Take one batch of envelope rows."""

    def close(self) -> None:
        """Finish. Called when a stream ends, for every sink."""


SINKS: dict[str, type[Sink]] = {}


def register(kind: type[Sink]) -> type[Sink]:
    SINKS[kind.name] = kind
    return kind


def create(name: str, *args, **options) -> Sink:
    if name not in SINKS:
        raise ConfigError(f"no sink {name}; there are {', '.join(sorted(SINKS))}")
    return SINKS[name](*args, **options)


def _told(log: DataFrame) -> Result:
    r = ops.data_records(log).agg(F.count("*").alias("n"), F.max("pos").alias("pos")).first()
    return Result(r.n, None if r.pos is None else int(r.pos))


@register
class RawParquet(Sink):
    """Staging rows in folders by batch; a batch that comes again replaces its folder."""

    name = "raw_parquet"
    capabilities = Capabilities(False, True, True, False, 500_000, 30_000)

    def __init__(self, spark: SparkSession, path: str, records_per_file: int = 1_000_000):
        self.spark, self.path, self.most = spark, path, records_per_file

    def write(self, log: DataFrame, batch: int) -> Result:
        rows = raw.project(log.withColumn("batch_id", F.lit(batch).cast("long"))).drop("_batch_id")
        rows.write.mode("overwrite").option("maxRecordsPerFile", self.most).parquet(f"{self.path}/_batch_id={batch}")
        return _told(log)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).withColumn("_batch_id", F.col("_batch_id").cast("long"))

    def pending(self, after: int) -> list[int]:
        """Staged batches beyond a pointer, in order."""
        ids = [int(f.split("=")[1]) for f in Files(self.spark, self.path).folders() if f.startswith("_batch_id=")]
        return sorted(b for b in ids if b > after)

    def drop(self, upto: int) -> None:
        """Delete staged batches that targets hold."""
        for b in self.pending(-1):
            if b <= upto:
                Files(self.spark, self.path).remove(f"_batch_id={b}")


@register
class JsonFiles(Sink):
    """Row images with audit columns as JSON lines, in folders by table and batch. Columns that weren't sent are absent in a line."""

    name = "json_files"
    capabilities = Capabilities(True, True, True, False, 100_000, 5_000)

    def __init__(self, spark: SparkSession, path: str, internal_prefix: str = "_"):
        self.spark, self.path, self.prefix = spark, path, internal_prefix

    def write(self, log: DataFrame, batch: int) -> Result:
        rows = ops.without_internal(ops.data_records(log), self.prefix)
        image = F.coalesce(F.when(F.col("op") == 2, F.col("before")).otherwise(F.col("after")), F.lit("{}"))
        body = F.regexp_replace(image, r"\}\s*$", "")
        audit = F.to_json(F.struct(F.col("op").alias("_op_type"), (F.col("op") == 2).alias("_is_deleted"), F.coalesce("pos", F.lit(0)).alias("_cdc_version")))
        line = F.concat(body, F.when(F.trim(body) == "{", "").otherwise(","), F.substring(audit, 2, 1_000_000))
        rows.select(line.alias("value"), F.concat_ws(".", F.when(F.col("src_schema") != "", F.col("src_schema")), "src_table").alias("table")).write.mode("overwrite").partitionBy("table").text(f"{self.path}/batch={batch}")
        return _told(log)


@register
class Merged(Sink):
    """Targets of tracked tables, merged batch by batch."""

    name = "merged"
    capabilities = Capabilities(True, True, True, True, 250_000, 10_000)

    def __init__(self, targets: dict[str, Target]):
        self.normalizer = Normalizer(targets)

    def validate(self) -> None:
        if not self.normalizer.targets:
            raise SinkError("no targets")

    def write(self, log: DataFrame, batch: int) -> Result:
        self.normalizer(log, batch)
        return _told(log)


@register
class Recording(Sink):
    """Keeps what it was given, for tests."""

    name = "recording"

    def __init__(self):
        self.batches: dict[int, list] = {}
        self.closed = False

    def write(self, log: DataFrame, batch: int) -> Result:
        self.batches[batch] = log.collect()
        return Result(len(self.batches[batch]), None)

    def close(self) -> None:
        self.closed = True


def drain(staged: RawParquet, targets: dict[str, Target], attempts: int = 3, wait: float = 1.0) -> int:
    """Merge all staged batches into the targets, in order, then delete them. A batch that fails is tried again after a growing wait; one that
    fails `attempts` times stops the drain, none is skipped. A target's publication moves its pointer with its rows, so a batch that
    was merged but not yet deleted changes nothing when it is tried again."""
    done = 0
    for batch in staged.pending(-1):
        for k in range(attempts):
            try:
                rows = staged.read().where(F.col("_batch_id") == batch)
                for name, target in targets.items():
                    target.apply(raw.typed(rows.where(F.col("_dst_table") == name), target.schema), batch)
                staged.drop(batch)
                break
            except Exception:
                if k + 1 == attempts:
                    raise
                time.sleep(wait * 2**k)
        done += 1
    return done
