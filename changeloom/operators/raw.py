"""The staging form of a log: one row a record with its image as JSON, and typed reading back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions import scalar, types
from changeloom.model import DELETE
from changeloom.operators import merge as ops

# Fixed value: the catalog's number of the money type.
MONEY_OID = 790


def project(log: DataFrame) -> DataFrame:
    """Envelope data rows as staging rows. The order key is the position, or the commit time in nanoseconds for rows without one."""
    data = ops.data_records(log)
    name = F.concat_ws(".", F.when(F.col("src_schema") != "", F.col("src_schema")), "src_table")
    order = F.coalesce(F.col("pos"), (F.unix_micros("commit_ts") * 1000).cast("decimal(20,0)"))
    return data.select(
        order.alias("_timestamp"),
        name.alias("_dst_table"),
        F.when(F.col("op") == DELETE, F.col("before")).otherwise(F.col("after")).alias("_data"),
        F.col("op").cast("smallint").alias("_record_type"),
        F.when(F.col("op") != 0, F.col("before")).alias("_match_data"),
        F.col("batch_id").alias("_batch_id"),
        F.coalesce("unchanged", F.array().cast("array<string>")).alias("_unchanged"),
        F.col("seq").alias("_seq"),
    )


def extract(json: Column, name: str, kind: T.DataType, lenient: bool = False) -> Column:
    """A field of a JSON image in a type. Strict: text that doesn't fit is an error; lenient: null. Bytes are hexadecimal."""
    path = f"$['{name}']"
    text = F.get_json_object(json, path)
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.from_json(text, kind)
    return text.try_cast(kind) if lenient else text.cast(kind)


def extract_variant(json: Column, name: str, data_type: str, oid: int | None = None, precision: int = 38, scale: int = 9) -> Column:
    """A field of a JSON image by its source type: bytes from base64, JSON as JSON text (null if it isn't JSON), decimals where they parse, money texts without
    their signs, arrays as JSON arrays, all else cast."""
    text = F.get_json_object(json, f"$['{name}']")
    if oid == MONEY_OID:
        return scalar.strip_money(text).try_cast(types.spark_type("Decimal", precision, scale))
    if oid in types.PG_ARRAY_OID or data_type in ("Json", "Jsonb"):
        return F.when(F.try_parse_json(text).isNotNull(), text)
    if data_type == "Bytes":
        return F.unbase64(text)
    kind = types.spark_type(data_type, precision, scale)
    return text.try_cast(kind) if data_type == "Decimal" else text.cast(kind)


def typed(raw: DataFrame, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Staging rows of one table as a log in the columns of schema."""
    cols = [extract(F.col("_data"), f.name, f.dataType, lenient).alias(f.name) for f in schema.fields]
    return raw.select(*cols, F.col("_record_type").cast("int").alias("op"), F.col("_timestamp").alias("pos"), F.col("_seq").alias("seq"), F.col("_unchanged").alias("unchanged"), F.col("_batch_id").alias("batch_id"))


def normalize_range(target: DataFrame, raw: DataFrame, table: str, schema: T.StructType, keys: list[str], after: int, upto: int, deletes: str = "hard", mode: str = "column") -> DataFrame:
    """The target after all staged batches in (after, upto], as one merge."""
    mine = raw.where((F.col("_batch_id") > after) & (F.col("_batch_id") <= upto) & (F.col("_dst_table") == table))
    return ops.merge(target, typed(mine, schema), keys, [f.name for f in schema.fields if f.name not in keys], deletes, mode)


def missing_tables(wanted: DataFrame, published: DataFrame, default: str = "public") -> DataFrame:
    """The wanted tables (table_name) that aren't published; a name without a schema is one of the default schema."""
    full = F.when(F.contains("table_name", F.lit(".")), F.col("table_name")).otherwise(F.concat(F.lit(f"{default}."), "table_name"))
    return wanted.withColumn("_full", full).join(published.select(full.alias("_full")), "_full", "left_anti").drop("_full")


def pointers(batches: DataFrame) -> DataFrame:
    """(batch_id, pointer) of rows (batch_id, pos): the highest position up to each batch, so a pointer never goes back. One row a batch stands in the window."""
    by_batch = batches.groupBy("batch_id").agg(F.max("pos").alias("pos"))
    return by_batch.select("batch_id", F.max("pos").over(W.orderBy("batch_id")).alias("pointer"))


def replica_identity(code: Column) -> Column:
    """What a table's replica identity means for change capture."""
    # The codes of the catalog.
    return F.when(code == "f", "ok").when(code == "d", "warning: old values hold the key only").when(code == "n", "error: no old values").when(code == "i", "info: old values hold an index's columns")
