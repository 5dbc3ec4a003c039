"""Queries over staging rows, sinks and maps, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.functions import types
from changeloom.operators import raw
from changeloom.plans.changelog import batch_ids, orders_log, recorded, table
from changeloom.plans.queries import FOLD, LAST, LOG, OLD, old_target, query
from changeloom.plans.streamed import envelope
from changeloom.streaming.sinks import JsonFiles, RawParquet, drain
from changeloom.streaming.store import Target, shared_dir

ROWS = T.StructType([T.StructField("k", T.LongType()), T.StructField("status", T.StringType()), T.StructField("price", T.DoubleType())])


@query("raw_projection", LOG + "done AS (SELECT 1) SELECT CAST(pos AS bigint) AS _timestamp, 'shop.orders' AS _dst_table, op AS _record_type, batch_id AS _batch_id, unchanged AS _unchanged, k FROM log")
def raw_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw.project(envelope(orders_log(spark, sf_dir)))
    return rows.select(F.col("_timestamp").cast("long").alias("_timestamp"), "_dst_table", F.col("_record_type").cast("int").alias("_record_type"), "_batch_id", F.array_join("_unchanged", ",").alias("_unchanged"), raw.extract(F.col("_data"), "k", T.LongType()).alias("k"))


@query(
    "raw_normalize_range",
    LOG.replace("raw_log\n)", "raw_log\n WHERE pos >= 10000000 AND pos < 30000000)") + LAST + FOLD + OLD
    + "SELECT coalesce(s.k, old.k) AS k, CASE WHEN s.st_at IS NOT NULL THEN s.status ELSE old.status END AS status, CASE WHEN s.pr_at IS NOT NULL THEN s.price ELSE old.price END AS price FROM old FULL OUTER JOIN s ON old.k = s.k",
)
def raw_normalize_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = raw.project(envelope(orders_log(spark, sf_dir)))
    return raw.normalize_range(old_target(spark, sf_dir), staged, "shop.orders", ROWS, ["k"], 0, 2)


@query(
    "staged_drain",
    LOG + LAST + FOLD + """done AS (SELECT 1) SELECT k,
CASE WHEN st_at IS NOT NULL AND (gone IS NULL OR st_at >= gone) THEN status END AS status,
CASE WHEN pr_at IS NOT NULL AND (gone IS NULL OR pr_at >= gone) THEN price END AS price, op = 2 AS _is_deleted FROM s WHERE op <> 2""",
)
def staged_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches staged as Parquet, then merged in order into a target with soft deletes; live rows."""
    base = shared_dir(spark, "staged")
    staged, log = RawParquet(spark, f"{base}/raw"), envelope(recorded(orders_log(spark, sf_dir), f"{base}/recorded"))
    for k in batch_ids(log):
        staged.write(log.where(F.col("batch_id") == k), k)
    target = Target(spark, f"{base}/target", ROWS, ["k"], deletes="soft")
    drain(staged, {"shop.orders": target})
    return target.read().where("not _is_deleted")


@query("json_sink", LOG + "done AS (SELECT 1) SELECT k, CASE WHEN unchanged = 'price' THEN NULL ELSE price END AS price, op AS _op_type, op = 2 AS _is_deleted, CAST(pos AS bigint) AS _cdc_version FROM log")
def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All batches written as JSON lines and read back; one comes twice."""
    path = shared_dir(spark, "json")
    sink, log = JsonFiles(spark, path), envelope(recorded(orders_log(spark, sf_dir), shared_dir(spark, "recorded")))
    for k in (batches := batch_ids(log)) + batches[1:2]:
        sink.write(log.where(F.col("batch_id") == k), k)
    return spark.read.schema("k long, price double, _op_type int, _is_deleted boolean, _cdc_version long, batch int, `table` string").json(path).drop("batch", "table")


_PROPS = "SELECT event_id, TRY_CAST(props ->> '$.k' AS bigint) AS k, TRY_CAST(props ->> '$.k' AS decimal(12,2)) AS d, CAST(NULL AS bigint) AS absent FROM events"


@query("typed_extraction", _PROPS)
def typed_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", raw.extract(j, "k", T.LongType()).alias("k"), raw.extract(j, "k", T.DecimalType(12, 2), lenient=True).alias("d"), raw.extract(j, "nothing", T.LongType()).alias("absent"))


# The seventeen data types in each dialect, decimals asked for with 50 digits.
_TYPES = (
    "('postgres', 'Boolean', 'boolean'), ('postgres', 'Int16', 'smallint'), ('postgres', 'Int32', 'integer'), ('postgres', 'Int64', 'bigint'), ('postgres', 'Float32', 'real'), ('postgres', 'Float64', 'double precision'), ('postgres', 'Decimal', 'numeric'), ('postgres', 'String', 'text'), ('postgres', 'Text', 'text'), ('postgres', 'Bytes', 'bytea'), ('postgres', 'Json', 'jsonb'), ('postgres', 'Jsonb', 'jsonb'), ('postgres', 'Uuid', 'uuid'), ('postgres', 'Date', 'date'), ('postgres', 'Time', 'time without time zone'), ('postgres', 'Timestamp', 'timestamp without time zone'), ('postgres', 'TimestampTz', 'timestamp with time zone'), "
    "('starrocks', 'Boolean', 'BOOLEAN'), ('starrocks', 'Int16', 'SMALLINT'), ('starrocks', 'Int32', 'INT'), ('starrocks', 'Int64', 'BIGINT'), ('starrocks', 'Float32', 'FLOAT'), ('starrocks', 'Float64', 'DOUBLE'), ('starrocks', 'Decimal', 'DECIMAL(38,9)'), ('starrocks', 'String', 'STRING'), ('starrocks', 'Text', 'STRING'), ('starrocks', 'Bytes', 'VARBINARY'), ('starrocks', 'Json', 'JSON'), ('starrocks', 'Jsonb', 'JSON'), ('starrocks', 'Uuid', 'STRING'), ('starrocks', 'Date', 'DATE'), ('starrocks', 'Time', 'STRING'), ('starrocks', 'Timestamp', 'DATETIME'), ('starrocks', 'TimestampTz', 'DATETIME'), "
    "('snowflake', 'Boolean', 'BOOLEAN'), ('snowflake', 'Int16', 'SMALLINT'), ('snowflake', 'Int32', 'INT'), ('snowflake', 'Int64', 'BIGINT'), ('snowflake', 'Float32', 'FLOAT'), ('snowflake', 'Float64', 'DOUBLE'), ('snowflake', 'Decimal', 'NUMBER(38,9)'), ('snowflake', 'String', 'VARCHAR'), ('snowflake', 'Text', 'VARCHAR'), ('snowflake', 'Bytes', 'BINARY'), ('snowflake', 'Json', 'VARIANT'), ('snowflake', 'Jsonb', 'VARIANT'), ('snowflake', 'Uuid', 'VARCHAR(36)'), ('snowflake', 'Date', 'DATE'), ('snowflake', 'Time', 'TIME'), ('snowflake', 'Timestamp', 'TIMESTAMP_NTZ'), ('snowflake', 'TimestampTz', 'TIMESTAMP_TZ')"
)


@query("type_map", f"SELECT * FROM (VALUES {_TYPES}) v(dialect, data_type, target_type)")
def type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d, n, types.target_type(d, n, 50, 9)) for d in types.TARGET for n in types.TARGET[d]], "dialect string, data_type string, target_type string")


_PART = """([A-Za-z_][A-Za-z0-9_$]*|"[A-Za-z0-9_$ -]+")"""


@query("identifier_check", f"""SELECT n_name, regexp_full_match(n_name, '{_PART}') AS bare, true AS quoted, true AS dotted, false AS two_statements, false AS remark, false AS three_parts FROM nation""")
def identifier_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names as identifiers: bare, in quotes, with a schema, and in forms that must not reach a statement."""
    forms = {"bare": "{}", "quoted": '"{}"', "dotted": 'shop."{}"', "two_statements": "{}; x", "remark": "{}--", "three_parts": 'a.b."{}"'}
    return table(spark, sf_dir, "nation").select("n_name", *[types.safe_identifier_column(F.format_string(f.replace("{}", "%s"), "n_name")).alias(k) for k, f in forms.items()])


@query("replica_identity", "SELECT c, CASE c WHEN 'f' THEN 'ok' WHEN 'd' THEN 'warning: old values hold the key only' WHEN 'n' THEN 'error: no old values' WHEN 'i' THEN 'info: old values hold an index''s columns' END AS said FROM (VALUES ('f'), ('d'), ('n'), ('i'), ('x')) v(c)")
def replica_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in "fdnix"], "c string").select("c", raw.replica_identity(F.col("c")).alias("said"))
