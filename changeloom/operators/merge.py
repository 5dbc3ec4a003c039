"""Collapsing a change log to one row a key and merging it into a target.

A log has key columns, value columns, op (0 insert, 1 update, 2 delete), pos and seq (a total order within a key) and, where rows
may leave columns out, unchanged (an array of column names). Collapsing is an aggregation, so it is pre-aggregated
before its one shuffle by key; merging is one full outer join on the same key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.model import DELETE, INSERT, UPDATE

ORDER = ("pos", "seq")


def _rank(log: DataFrame) -> Column:
    return F.struct(*[c for c in ORDER if c in log.columns])


def _left_out(log: DataFrame, column: str) -> Column:
    return F.coalesce(F.array_contains("unchanged", column), F.lit(False)) if "unchanged" in log.columns else F.lit(False)


def latest_by_key(log: DataFrame, keys: list[str]) -> DataFrame:
    """The record of the highest (pos, seq) of each key."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), _rank(log)).alias("_r"))
    return last.select(*keys, "_r.*").select(*log.columns)


def collapse(log: DataFrame, keys: list[str], values: list[str], mode: str = "column") -> DataFrame:
    """One row a key: op of its last record, and for each value column a struct (known, v).

    mode "column": the latest value that was sent for the column since the last delete; a column never sent is known to be null
    after a delete in this log and otherwise unknown. mode "record": what the last record sent. Unknown columns keep the target's value."""
    rank = _rank(log)
    if mode == "record":
        last = latest_by_key(log, keys)
        return last.select(*keys, "op", *[F.struct((~_left_out(last, c)).alias("known"), F.col(c).alias("v")).alias(c) for c in values])
    data = [F.max_by("op", rank).alias("op"), F.max(F.when(F.col("op") == DELETE, rank)).alias("_gone")]
    sent = {c: F.when(~_left_out(log, c), rank) for c in values}
    data += [F.max_by(F.struct(rank.alias("at"), F.col(c).alias("v")), sent[c]).alias(c) for c in values]
    out = log.groupBy(*keys).agg(*data)
    fresh = lambda c: F.col(c).isNotNull() & (F.col("_gone").isNull() | (F.col(f"{c}.at") > F.col("_gone")) | ((F.col("op") == DELETE) & (F.col(f"{c}.at") == F.col("_gone"))))
    known = lambda c: fresh(c) | F.col("_gone").isNotNull()
    return out.select(*keys, "op", *[F.struct(known(c).alias("known"), F.when(fresh(c), F.col(f"{c}.v")).alias("v")).alias(c) for c in values])


def merge(target: DataFrame, log: DataFrame, keys: list[str], values: list[str], deletes: str = "hard", mode: str = "column") -> DataFrame:
    """The target after the log. deletes "hard" removes rows; "soft" keeps them with _is_deleted set: a row that was there keeps its
    values, one that wasn't becomes a row of the delete's image. An upsert clears the mark; columns that it leaves out are null then."""
    t = target.select(*[F.col(k).alias(f"t_{k}") for k in keys], *[F.col(c).alias(f"t_{c}") for c in values], (F.col("_is_deleted") if "_is_deleted" in target.columns else F.lit(False)).alias("t_gone"), F.lit(True).alias("t_here"))
    s = collapse(log, keys, values, mode).withColumn("s_here", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"t_{k}") for k in keys])
    both = t.join(s, on, "full_outer")
    is_delete = F.coalesce(F.col("op") == DELETE, F.lit(False))
    keep_old = F.col("s_here").isNull() | (is_delete & F.col("t_here").isNotNull())
    value = lambda c: F.when(keep_old, F.col(f"t_{c}")).when(F.col(f"{c}.known"), F.col(f"{c}.v")).when(~F.coalesce("t_gone", F.lit(False)), F.col(f"t_{c}")).alias(c)
    out = [F.coalesce(k, f"t_{k}").alias(k) for k in keys] + [value(c) for c in values]
    if deletes == "hard":
        return both.where(~is_delete).select(*out)
    mark = F.when(F.col("s_here").isNull(), F.col("t_gone")).otherwise(is_delete).alias("_is_deleted")
    return both.select(*out, mark)


AT = "struct<pos:decimal(20,0),seq:bigint>"


def state_of(log: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The log as one row a key that combine() puts together with others in any order: _last (position and op of the last record), _gone (position
    of the last delete) with its _image, and for each value column the latest value that was sent, with its position."""
    seq = F.col("seq") if "seq" in log.columns else F.lit(0)
    rank = F.struct(F.col("pos").cast("decimal(20,0)").alias("pos"), seq.cast("bigint").alias("seq"))
    gone = F.when(F.col("op") == DELETE, rank)
    sent = {c: F.when((F.col("op") != DELETE) & ~_left_out(log, c), rank) for c in values}
    return log.groupBy(*keys).agg(
        F.max(F.struct(rank.alias("at"), F.col("op").cast("int").alias("op"))).alias("_last"),
        F.max(gone).alias("_gone"),
        F.max_by(F.struct(*values), gone).alias("_image"),
        *[F.max_by(F.struct(rank.alias("at"), F.col(c).alias("v")), sent[c]).alias(c) for c in values],
    )


def combine(states: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of several state_of() results as one row a key. The order in which they came doesn't matter, and repeats change nothing."""
    return states.groupBy(*keys).agg(F.max("_last").alias("_last"), F.max("_gone").alias("_gone"), F.max_by("_image", "_gone").alias("_image"), *[F.max_by(c, F.col(f"{c}.at")).alias(c) for c in values])


def visible(state: DataFrame, keys: list[str], values: list[str], deletes: str = "hard") -> DataFrame:
    """The table that a state stands for. A value sent before the last delete is gone. deletes "soft": deleted rows stay, marked by
    _is_deleted, with the delete's image, or the last value sent where that is null."""
    is_delete = F.col("_last.op") == DELETE
    fresh = lambda c: F.when(F.col("_gone").isNull() | (F.col(f"{c}.at") > F.col("_gone")), F.col(f"{c}.v"))
    if deletes == "hard":
        return state.where(~is_delete).select(*keys, *[fresh(c).alias(c) for c in values])
    held = lambda c: F.when(is_delete, F.coalesce(F.col("_image")[c], F.col(f"{c}.v"))).otherwise(fresh(c))
    return state.select(*keys, *[held(c).alias(c) for c in values], is_delete.alias("_is_deleted"))


def split_key_changes(log: DataFrame, keys: list[str], before: str = "before_{}") -> DataFrame:
    """Updates that change the key become a delete of the old key and an insert of the new one at the same position.

    The old key is read from columns named by `before`; the delete sorts before the insert."""
    old = {k: F.col(before.format(k)) for k in keys}
    moved = (F.col("op") == UPDATE) & reduce(lambda a, b: a | b, [old[k].isNotNull() & (old[k] != F.col(k)) for k in keys])
    rest = [c for c in log.columns if c not in keys and c not in ("op", "seq") and c not in [before.format(k) for k in keys]]
    as_row = lambda op, named, seq: F.struct(F.lit(op).cast("int").alias("op"), *[named(k).alias(k) for k in keys], seq.alias("seq"))
    seq = F.col("seq") if "seq" in log.columns else F.lit(0)
    rows = F.when(moved, F.array(as_row(DELETE, old.__getitem__, seq * 2), as_row(INSERT, F.col, seq * 2 + 1))).otherwise(
        F.array(F.struct(F.col("op").cast("int").alias("op"), *[F.col(k).alias(k) for k in keys], (seq * 2 + 1).alias("seq")))
    )
    return log.withColumn("_rows", F.explode(rows)).select("_rows.*", *rest)


def with_audit(rows: DataFrame, version: Column, now: Column | None = None) -> DataFrame:
    """The four audit columns, always written. version is null-safe: 0 without a number."""
    return rows.withColumns(
        {"_op_type": F.col("op").cast("tinyint"), "_is_deleted": F.col("op") == DELETE, "_synced_at": now if now is not None else F.current_timestamp(), "_cdc_version": F.coalesce(version.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))}
    )


def data_records(log: DataFrame) -> DataFrame:
    return log.where(F.col("op").isin(INSERT, UPDATE, DELETE))


def batch_range(log: DataFrame, after: int, upto: int, tables: list[str] | None = None) -> DataFrame:
    out = log.where((F.col("batch_id") > after) & (F.col("batch_id") <= upto))
    return out.where(F.col("src_table").isin(tables)) if tables else out


def tracked(log: DataFrame, tables: DataFrame) -> DataFrame:
    """Rows of tracked tables; schema changes also pass when their schema holds any tracked table."""
    data = log.where(F.col("op") != 10).join(tables, ["src_schema", "src_table"], "left_semi")
    return data.unionByName(log.where(F.col("op") == 10).join(tables, ["src_schema"], "left_semi"))


def without_internal(log: DataFrame, prefix: str) -> DataFrame:
    return log.where(~F.startswith(F.col("src_table"), F.lit(prefix)))


def unchanged_sets(log: DataFrame) -> DataFrame:
    """Distinct combinations of unchanged columns by table, deletes aside."""
    names = F.array_join(F.array_sort(F.coalesce("unchanged", F.array().cast("array<string>"))), ",")
    return log.where(F.col("op") != DELETE).select("src_table", names.alias("unchanged")).distinct()


def last_position(log: DataFrame) -> DataFrame:
    """The highest position by table of records that carry one and may be acknowledged."""
    return log.where(F.col("pos").isNotNull() & ~F.col("op").isin(10, 11)).groupBy("src_table").agg(F.max(F.struct("pos", "seq")).alias("m")).select("src_table", "m.pos", "m.seq")
