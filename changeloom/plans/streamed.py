"""Queries that run a stream or read recorded bytes, with SQL for what must come out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.plans.changelog import batch_ids, orders_log, recorded, table
from changeloom.plans.queries import FOLD, LAST, LOG, query
from changeloom.sources import pgoutput
from changeloom.streaming.normalize import Normalizer, start
from changeloom.streaming.store import Target, shared_dir

_RESULT = LOG + LAST + FOLD + """done AS (SELECT 1) SELECT k,
CASE WHEN st_at IS NOT NULL AND (gone IS NULL OR st_at >= gone) THEN status END AS status,
CASE WHEN pr_at IS NOT NULL AND (gone IS NULL OR pr_at >= gone) THEN price END AS price FROM s WHERE op <> 2"""


def envelope(log: DataFrame) -> DataFrame:
    """The orders log as envelope rows: images as JSON, unsent columns left out."""
    from changeloom.functions.scalar import image_json

    image = image_json(["k", "status", "price"], F.col("unchanged"))
    return log.select(
        F.lit("shop").alias("src_schema"), F.lit("orders").alias("src_table"), F.col("op").cast("tinyint").alias("op"), F.when(F.col("op") == 2, image).alias("before"), F.when(F.col("op") != 2, image).alias("after"), "unchanged",
        F.lit("lsn").alias("pos_kind"), F.col("pos").cast("decimal(20,0)").alias("pos"), F.lit(None).cast("string").alias("pos_file"), F.lit(None).cast("string").alias("pos_gtid"), "seq",
        F.lit("2024-01-01").cast("timestamp").alias("commit_ts"), F.lit(1).cast("long").alias("xid"), F.lit(False).alias("is_snapshot"), "batch_id",
    )


@query("stream_normalize", _RESULT)
def stream_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that come one after another as Parquet files of a stream; every micro-batch is one of them, merged into a target and published."""
    base = shared_dir(spark, "stream")
    log = recorded(orders_log(spark, sf_dir), f"{base}/recorded")
    target = Target(spark, f"{base}/target", spark.createDataFrame([], "k long, status string, price double").schema, ["k"])
    for k in batch_ids(log):
        batch = envelope(log.where(F.col("batch_id") == k))
        batch.write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(batch.schema).parquet(f"{base}/log")
        start(stream, Normalizer({"shop.orders": target}), f"{base}/checkpoint").awaitTermination()
    return target.read()


@query("wire_decode", "SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price, CAST(0 AS tinyint) AS op FROM orders UNION ALL SELECT o_orderkey, NULL, NULL, 2 FROM orders WHERE o_orderkey % 5 = 0")
def wire_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as logical-replication frames, in eight recorded segments, and decoded again."""
    columns = [("k", 20, 1), ("status", 25, 0), ("price", 701, 0)]

    def record(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                out.append((r.segment, 2 * r.k + 2, pgoutput.frame(pgoutput.insert(7, [str(r.k), r.status, repr(float(r.price))]), r.k)))
                if r.k % 5 == 0:
                    out.append((r.segment, 2 * r.k + 3, pgoutput.frame(pgoutput.delete(7, [str(r.k), None, None]), 10**7 + r.k)))
            yield pd.DataFrame(out, columns=["segment", "n", "data"])

    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderstatus AS status", "o_totalprice AS price", "cast(o_orderkey % 8 AS int) AS segment")
    first = spark.createDataFrame([(s, 0, pgoutput.frame(pgoutput.relation(7, "shop", "orders", columns), 0)) for s in range(8)], "segment int, n long, data binary")
    frames = first.unionByName(rows.mapInPandas(record, "segment int, n long, data binary"))
    log = pgoutput.replay(frames, ["segment"]).where("op in (0, 1, 2)")
    return log.select(F.from_json(F.coalesce("after", "before"), "k long, status string, price double").alias("i"), "op").select("i.*", "op")
