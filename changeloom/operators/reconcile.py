"""Reconciling snapshot rows with the log by position.

Joins by key range have the table and a cell of the key as equi-keys (snapshot.cells), so neither side has to travel whole and the rows of
one table don't meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.model import DELETE
from changeloom.operators.snapshot import cells


def drop_snapshotted(log: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """The log without inserts and updates that a finished chunk (src_table, start_pk, end_pk, hw) already holds: those of its key
    range at or below its high position. Deletes and rows without a key pass."""
    log, c = cells(log, key, chunks.select(F.col("src_table").alias("c_table"), "start_pk", "end_pk", "hw"))
    c = c.withColumnRenamed("_cell", "c_cell")
    held = (
        (F.col("src_table") == F.col("c_table"))
        & (F.col("_cell") == F.col("c_cell"))
        & (F.col(key) >= F.col("start_pk"))
        & (F.col(key) < F.col("end_pk"))
        & (F.col("pos") <= F.col("hw"))
        & (F.col("op") != DELETE)
    )
    return log.join(c, held, "left_anti").drop("_cell")


def evictions(log: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """(src_table, partition_id, key) changed inside a chunk's window (low, high]: the log has newer rows than the chunk's read."""
    log, c = cells(log, key, chunks.select(F.col("src_table").alias("c_table"), "partition_id", "start_pk", "end_pk", "low", "high"))
    c = c.withColumnRenamed("_cell", "c_cell")
    on = (
        (F.col("src_table") == F.col("c_table"))
        & (F.col("_cell") == F.col("c_cell"))
        & (F.col(key) >= F.col("start_pk"))
        & (F.col(key) < F.col("end_pk"))
        & (F.col("pos") > F.col("low"))
        & (F.col("pos") <= F.col("high"))
    )
    return log.join(c, on).select("src_table", "partition_id", key).distinct()


def without_evicted(rows: DataFrame, evicted: DataFrame, key: str) -> DataFrame:
    return rows.join(evicted, ["src_table", "partition_id", key], "left_anti")


def snapshot_and_log(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """Both as one log. Snapshot rows carry their chunk's high position and lose ties to log rows."""
    return snapshot.withColumn("seq", F.lit(-1).cast("long")).unionByName(log, allowMissingColumns=True)
