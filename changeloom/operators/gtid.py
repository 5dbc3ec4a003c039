"""Algebra of transaction-id sets, as rows (set_id, uuid, lo, hi) of inclusive intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse(sets: DataFrame, text: str = "gtid") -> DataFrame:
    """Rows of texts uuid:a-b:c,uuid2:... with all other columns kept. Blank texts have no rows. A part without an interval or with
    something that isn't a number is an error."""
    rest = [c for c in sets.columns if c != text]
    part = sets.where(F.trim(F.col(text)) != "").select(*rest, F.explode(F.split(text, ",")).alias("part")).withColumn("bits", F.split(F.trim("part"), ":"))
    ok = F.when(F.size("bits") >= 2, F.slice("bits", 2, F.size("bits") - 1)).otherwise(F.raise_error(F.concat(F.lit("no interval in "), "part")))
    each = part.select(*rest, F.trim(F.col("bits")[0]).alias("uuid"), F.explode(ok).alias("run")).withColumn("ends", F.split("run", "-"))
    return each.select(*rest, "uuid", F.trim(F.col("ends")[0]).cast("long").alias("lo"), F.trim(F.element_at("ends", -1)).cast("long").alias("hi"))


def coalesce(rows: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of each (set_id, uuid) as one: gaps and islands."""
    by = W.partitionBy("set_id", "uuid").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(W.unboundedPreceding, -1))
    island = rows.withColumn("new", F.when(before.isNull() | (F.col("lo") > before + 1), 1).otherwise(0)).withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("set_id", "uuid", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def superset(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (a, b) of set ids: is_superset, whether set a holds all of set b. An empty b is held by any set."""
    merged = coalesce(sets)
    b = pairs.join(sets.select(F.col("set_id").alias("b"), "uuid", "lo", "hi"), "b")
    a = merged.select(F.col("set_id").alias("a"), "uuid", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    missing = b.join(a, (b["a"] == a["a"]) & (b["uuid"] == a["uuid"]) & (F.col("a_lo") <= F.col("lo")) & (F.col("a_hi") >= F.col("hi")), "left_anti")
    return pairs.join(missing.select("a", "b").distinct().withColumn("miss", F.lit(True)), ["a", "b"], "left").select("a", "b", F.col("miss").isNull().alias("is_superset"))


def holds(points: DataFrame, sets: DataFrame, set_id: str) -> DataFrame:
    """The points (uuid, n) that the set named set_id holds."""
    s = sets.where(F.col("set_id") == set_id).select(F.col("uuid").alias("s_uuid"), "lo", "hi")
    return points.join(s, (F.col("uuid") == F.col("s_uuid")) & (F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi")), "left_semi")


def in_window(points: DataFrame, sets: DataFrame, low: str, high: str) -> DataFrame:
    """The points in (low, high]: held by set high and not by set low."""
    up = holds(points, sets, high)
    s = sets.where(F.col("set_id") == low).select(F.col("uuid").alias("s_uuid"), "lo", "hi")
    return up.join(s, (F.col("uuid") == F.col("s_uuid")) & (F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi")), "left_anti")


def add(sets: DataFrame, points: DataFrame) -> DataFrame:
    """The sets with points (set_id, uuid, n) added, coalesced."""
    return coalesce(sets.select("set_id", "uuid", "lo", "hi").unionByName(points.select("set_id", "uuid", F.col("n").alias("lo"), F.col("n").alias("hi"))))


def text(rows: DataFrame) -> DataFrame:
    """(set_id, gtid): uuids and intervals in order."""
    run: Column = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    one = rows.groupBy("set_id", "uuid").agg(F.array_sort(F.collect_list(F.struct("lo", run.alias("r")))).alias("runs"))
    one = one.select("set_id", F.concat_ws(":", "uuid", F.array_join("runs.r", ":")).alias("part"))
    return one.groupBy("set_id").agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("gtid"))


def sid_text(sid: Column) -> Column:
    """A 16-byte server id as text."""
    h = F.lower(F.hex(sid))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
