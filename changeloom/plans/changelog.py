"""Change logs derived from driver tables. The SQL text runs unchanged in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Over orders: inserts of all keys, price updates of every third, updates without the price of every seventh, deletes of every
#: eleventh, and inserts anew of every twenty-second. Positions are unique within a key.
ORDERS_LOG = """
SELECT k, status, price, op, unchanged, pos, CAST(pos / 10000000 - 0.5 AS bigint) AS batch_id FROM (
SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, 0 AS op, '' AS unchanged, o_orderkey AS pos FROM {orders}
UNION ALL
SELECT o_orderkey, 'U', o_totalprice * 1.5, 1, '', 10000000 + o_orderkey FROM {orders} WHERE o_orderkey % 3 = 0
UNION ALL
SELECT o_orderkey, 'T', CAST(NULL AS double), 1, 'price', 20000000 + o_orderkey FROM {orders} WHERE o_orderkey % 7 = 0
UNION ALL
SELECT o_orderkey, o_orderstatus, o_totalprice, 2, '', 30000000 + o_orderkey FROM {orders} WHERE o_orderkey % 11 = 0
UNION ALL
SELECT o_orderkey, 'R', o_totalprice + 1, 0, '', 40000000 + o_orderkey FROM {orders} WHERE o_orderkey % 22 = 0
) raw_log
"""
ORDERS_LOG = ORDERS_LOG.replace("CAST(pos / 10000000 - 0.5 AS bigint)", "CAST(floor(pos / 10000000) AS bigint)")

#: Over conversations, whose key has two columns.
TURNS_LOG = """
SELECT conv_id, turn, role, text, 0 AS op, conv_id * 100 + turn AS pos FROM {conversations}
UNION ALL
SELECT conv_id, turn, role, 'edited', 1, 10000000 + conv_id * 100 + turn FROM {conversations} WHERE (conv_id + turn) % 3 = 0
UNION ALL
SELECT conv_id, turn, role, text, 2, 30000000 + conv_id * 100 + turn FROM {conversations} WHERE (conv_id * 7 + turn) % 11 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, status, price, op, unchanged (array), pos, seq, batch_id."""
    log = spark.sql(ORDERS_LOG, orders=table(spark, sf_dir, "orders"))
    return log.selectExpr("k", "status", "price", "op", "if(unchanged = '', array(), split(unchanged, ',')) AS unchanged", "pos", "0L AS seq", "batch_id")


def batch_ids(log: DataFrame) -> list[int]:
    """The batches of a log, in order; large keys reach into later ones."""
    return sorted(r.batch_id for r in log.select("batch_id").distinct().collect())


#: Positions that one file of a recorded log has at most; a batch has twenty such ranges.
SPAN = 500_000


def recorded(log: DataFrame, path: str) -> DataFrame:
    """The log written once, in folders by batch and files by ranges of positions, side by side: a batch is then read without the others."""
    log.repartition(F.floor(F.col("pos") / SPAN)).sortWithinPartitions("batch_id").write.partitionBy("batch_id").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def turns_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TURNS_LOG, conversations=table(spark, sf_dir, "conversations")).selectExpr("*", "0L AS seq")


def oracle_log() -> str:
    return ORDERS_LOG.format(orders="orders")


def oracle_turns() -> str:
    return TURNS_LOG.format(conversations="conversations")
