"""Snapshot chunks: planning, state and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHUNKS = 500_000
PENDING, IN_PROGRESS, COMPLETE = "PENDING", "IN_PROGRESS", "COMPLETE"


def key_range(rows: DataFrame, key: str) -> DataFrame:
    """One row: lo, hi and number of rows."""
    return rows.agg(F.min(key).cast("long").alias("lo"), F.max(key).cast("long").alias("hi"), F.count("*").alias("n"))


def plan(bounds: DataFrame, size: int, estimate: bool = True) -> DataFrame:
    """Chunks (partition_id, start_pk, end_pk) for each row of bounds (lo, hi, n): half-open ranges of equal width, the last ending
    after hi. The number of chunks follows the row estimate and the width of the range. Empty chunks are left out and leave
    gaps in the numbering; a table without rows has none."""
    by_range = F.ceil((F.col("hi") - F.col("lo")) / F.lit(float(size)))
    by_rows = F.least(F.ceil(F.greatest("n", F.lit(0)) / F.lit(float(size))), F.lit(MOST_CHUNKS)) if estimate else F.lit(0)
    number = F.greatest(F.lit(1), by_rows, by_range).cast("long")
    step = (F.col("hi") - F.col("lo")).cast("double") / F.col("chunks")
    at = lambda k: F.col("lo") + (k.cast("double") * step).cast("long")
    rest = [c for c in bounds.columns if c not in ("lo", "hi", "n")]
    out = bounds.where("lo is not null").withColumn("chunks", number).withColumn("partition_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    out = out.select(*rest, "partition_id", at(F.col("partition_id")).alias("start_pk"), F.when(F.col("partition_id") == F.col("chunks") - 1, F.col("hi") + 1).otherwise(at(F.col("partition_id") + 1)).alias("end_pk"))
    return out.where("start_pk < end_pk")


def scan(rows: DataFrame, key: str, start: int, end: int) -> DataFrame:
    """The rows of one chunk; the range reaches the scan as pushed filters."""
    return rows.where((F.col(key) >= start) & (F.col(key) < end))


def cells(rows: DataFrame, key: str, chunks: DataFrame, start: str = "start_pk", end: str = "end_pk") -> tuple[DataFrame, DataFrame]:
    """Both sides with _cell, a number that rows share with every chunk that may hold them: keys are dealt to cells as wide as the widest chunk,
    so a chunk stands in two cells at most. It turns a join by range into one by equality, which hashes and pre-sorts."""
    width = chunks.agg(F.max(F.col(end) - F.col(start))).first()[0] or 1
    cell = lambda c: F.expr(f"({c} - pmod({c}, {int(width)}L)) div {int(width)}L")
    return rows.withColumn("_cell", cell(f"cast(`{key}` as bigint)")), chunks.withColumn("_cell", F.explode(F.sequence(cell(f"`{start}`"), cell(f"(`{end}` - 1)"))))


def chunk_of(rows: DataFrame, key: str, chunks: DataFrame) -> DataFrame:
    """Rows with their chunk."""
    mine, theirs = cells(rows, key, chunks.select("partition_id", "start_pk", "end_pk"))
    return mine.join(theirs, "_cell").where((F.col(key) >= F.col("start_pk")) & (F.col(key) < F.col("end_pk"))).drop("_cell")


def to_do(chunks: DataFrame, state: DataFrame) -> DataFrame:
    """Chunks that aren't complete."""
    return chunks.join(state.where(F.col("status") == COMPLETE), ["table_name", "partition_id"], "left_anti")


def set_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """State rows after newer ones by (table_name, partition_id); a chunk never leaves COMPLETE."""
    rank = F.when(F.col("status") == COMPLETE, 2).when(F.col("status") == IN_PROGRESS, 1).otherwise(0)
    both = state.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in state.columns if c not in ("table_name", "partition_id")]
    out = both.groupBy("table_name", "partition_id").agg(F.max_by(F.struct(*rest), F.struct(rank, "_new")).alias("r"))
    return out.select("table_name", "partition_id", "r.*").select(*state.columns)


def add_missing(state: DataFrame, new: DataFrame) -> DataFrame:
    """State rows and those new ones whose chunk has none yet."""
    return state.unionByName(new.join(state, ["table_name", "partition_id"], "left_anti").select(*state.columns))


def progress(state: DataFrame) -> DataFrame:
    """By table: chunks, complete ones, rows copied, whether all are complete."""
    done = F.col("status") == COMPLETE
    return state.groupBy("table_name").agg(
        F.count("*").alias("chunks"),
        F.count_if(done).alias("complete"),
        F.count_if(F.col("status") == IN_PROGRESS).alias("in_progress"),
        F.coalesce(F.sum(F.when(done, F.col("rows_synced"))), F.lit(0)).cast("long").alias("rows_synced"),
        F.bool_and(done).alias("all_complete"),
    )


def integer_key(columns: DataFrame) -> DataFrame:
    """Of catalog rows (table_name, column_name, data_type, key_place) the first integer key column of each table."""
    fit = columns.where(F.col("key_place").isNotNull() & F.col("data_type").isin("Int16", "Int32", "Int64"))
    return fit.groupBy("table_name").agg(F.min_by("column_name", "key_place").alias("column_name"))


STATE = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("partition_id", T.LongType()),
        T.StructField("start_pk", T.LongType()),
        T.StructField("end_pk", T.LongType()),
        T.StructField("rows_synced", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("hw", T.DecimalType(20, 0)),
    ]
)
