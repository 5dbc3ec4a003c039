"""Schema comparison and additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.errors import SchemaError


def diff(cached: DataFrame, incoming: DataFrame) -> DataFrame:
    """(table_name, column_name, change, old_type, new_type) by name: added, dropped, type_changed. Rows: table_name, column_name,
    data_type, oid. A type has changed if its name differs, or both oids are known and differ. A table without cached rows is all added."""
    a = cached.select("table_name", "column_name", F.col("data_type").alias("old_type"), F.col("oid").alias("old_oid"))
    b = incoming.select("table_name", "column_name", F.col("data_type").alias("new_type"), F.col("oid").alias("new_oid"))
    both = a.join(b, ["table_name", "column_name"], "full_outer")
    changed = (F.col("old_type") != F.col("new_type")) | F.coalesce(F.col("old_oid") != F.col("new_oid"), F.lit(False))
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "dropped").when(changed, "type_changed")
    return both.select("table_name", "column_name", change.alias("change"), "old_type", "new_type").where("change is not null")


def missing(source: DataFrame, target: DataFrame) -> DataFrame:
    """Source columns (table_name, column_name) that the target lacks, in any case of letters."""
    low = lambda df: df.select("table_name", F.lower("column_name").alias("low"))
    return source.withColumn("low", F.lower("column_name")).join(low(target), ["table_name", "low"], "left_anti").select("table_name", "column_name")


def plan(known: dict[str, dict[str, str]], changes: list[tuple[str, dict[str, str]]]) -> list[tuple[str, str, str]]:
    """(table, column, type) to add for the schema changes of one batch, in order; repeats are folded, drops and new types need nothing."""
    have = {t: dict(c) for t, c in known.items()}
    out = []
    for table, columns in changes:
        mine = have.setdefault(table, {})
        for name, kind in columns.items():
            if name not in mine:
                out.append((table, name, kind))
                mine[name] = kind
    return out


def evolve(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the columns of schema: new ones null, no column lost. A column of another type is an error."""
    have = {f.name: f.dataType for f in rows.schema.fields}
    for f in schema.fields:
        if f.name in have and have[f.name] != f.dataType:
            raise SchemaError(f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    rest = [F.col(c) for c in have if c not in schema.fieldNames()]
    return rows.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], *rest)


def reconcile(known: T.StructType, source: T.StructType) -> tuple[list[T.StructField], list[str]]:
    """At start: the columns to add (nullable) and the names dropped at the source. Changed types are an error."""
    mine = {f.name: f.dataType for f in known.fields}
    if bad := [f.name for f in source.fields if f.name in mine and mine[f.name] != f.dataType]:
        raise SchemaError(f"types changed: {', '.join(bad)}")
    return [T.StructField(f.name, f.dataType, True) for f in source.fields if f.name not in mine], [n for n in mine if n not in source.fieldNames()]
