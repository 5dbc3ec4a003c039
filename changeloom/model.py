"""The change-record envelope and its codes."""

from __future__ import annotations

from pyspark.sql import types as T

# Record type codes of the raw table, and our own codes of records without data.
INSERT, UPDATE, DELETE = 0, 1, 2
SCHEMA_CHANGE, BEGIN, COMMIT, HEARTBEAT, TRUNCATE = 10, 11, 12, 13, 14

#: Row images are JSON at rest. Positions are unsigned 64-bit numbers and need decimal(20,0).
ENVELOPE = T.StructType(
    [
        T.StructField("src_schema", T.StringType()),
        T.StructField("src_table", T.StringType()),
        T.StructField("op", T.ByteType()),
        T.StructField("before", T.StringType()),
        T.StructField("after", T.StringType()),
        T.StructField("unchanged", T.ArrayType(T.StringType())),
        T.StructField("pos_kind", T.StringType()),
        T.StructField("pos", T.DecimalType(20, 0)),
        T.StructField("pos_file", T.StringType()),
        T.StructField("pos_gtid", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("commit_ts", T.TimestampType()),
        T.StructField("xid", T.LongType()),
        T.StructField("is_snapshot", T.BooleanType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

AUDIT = ("_op_type", "_is_deleted", "_synced_at", "_cdc_version")
