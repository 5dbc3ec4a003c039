"""Reading tables and catalogs of a database through Spark's JDBC source, for snapshots. Needs the database's driver on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeloom.functions.types import quote


def snapshot_reader(spark: SparkSession, url: str, table: str, key: str, lo: int, hi: int, chunks: int, **options: str) -> DataFrame:
    """A table read in key ranges, one task each."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=quote(table, '"'), **options)
    return reader.options(partitionColumn=key, lowerBound=str(lo), upperBound=str(hi + 1), numPartitions=str(chunks)).load()


#: Columns with type code, null flag and place in the primary key, of the tables of a schema.
PG_COLUMNS = """SELECT c.relname AS table_name, a.attname AS column_name, a.atttypid::int AS oid, NOT a.attnotnull AS nullable,
array_position(i.indkey::int[], a.attnum::int) AS key_place
FROM pg_class c JOIN pg_namespace n ON n.oid = c.relnamespace JOIN pg_attribute a ON a.attrelid = c.oid AND a.attnum > 0 AND NOT a.attisdropped
LEFT JOIN pg_index i ON i.indrelid = c.oid AND i.indisprimary WHERE n.nspname = '{schema}' ORDER BY c.relname, a.attnum"""
MYSQL_COLUMNS = """SELECT c.table_name, c.column_name, c.data_type, c.is_nullable = 'YES' AS nullable, k.ordinal_position AS key_place
FROM information_schema.columns c LEFT JOIN information_schema.key_column_usage k ON k.table_schema = c.table_schema
AND k.table_name = c.table_name AND k.column_name = c.column_name AND k.constraint_name = 'PRIMARY' WHERE c.table_schema = '{schema}'"""


def catalog(spark: SparkSession, url: str, kind: str, schema: str, **options: str) -> DataFrame:
    sql = (PG_COLUMNS if kind == "postgres" else MYSQL_COLUMNS).format(schema=schema.replace("'", "''"))
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()
