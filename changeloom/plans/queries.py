"""The registered queries over derived change logs, each with SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.functions import scalar
from changeloom.operators import gtid, merge, raw, reconcile, schema, snapshot
from changeloom.plans.changelog import oracle_log, oracle_turns, orders_log, table, turns_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


LOG = f"WITH log AS ({oracle_log()}), "
LAST = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS rn FROM log) x WHERE rn = 1), "
OLD = "old AS (SELECT o_orderkey AS k, o_orderstatus AS status, -o_totalprice AS price FROM orders WHERE o_orderkey % 2 = 0) "
#: By key: op of the last record, position of the last delete, and for each column the latest sent value with its position.
FOLD = """gone AS (SELECT k, max(pos) AS at FROM log WHERE op = 2 GROUP BY k),
st AS (SELECT * FROM (SELECT k, status, pos, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS rn FROM log WHERE op <> 2) x WHERE rn = 1),
pr AS (SELECT * FROM (SELECT k, price, pos, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS rn FROM log WHERE op <> 2 AND unchanged = '') x WHERE rn = 1),
s AS (SELECT last.k, last.op, gone.at AS gone, st.status, st.pos AS st_at, pr.price, pr.pos AS pr_at FROM last
 LEFT JOIN gone ON gone.k = last.k LEFT JOIN st ON st.k = last.k LEFT JOIN pr ON pr.k = last.k), """


def old_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that holds the even keys with other prices."""
    return table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "o_orderstatus AS status", "-o_totalprice AS price")


@query("dedup_latest_by_key", LOG + LAST + "done AS (SELECT 1) SELECT k, op, status, price, pos FROM last")
def dedup_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.latest_by_key(orders_log(spark, sf_dir), ["k"]).select("k", "op", "status", "price", "pos")


@query(
    "merge_hard_delete",
    LOG + LAST + OLD + "SELECT coalesce(last.k, old.k) AS k, CASE WHEN last.k IS NULL THEN old.status ELSE last.status END AS status, "
    "CASE WHEN last.k IS NULL OR last.unchanged = 'price' THEN old.price ELSE last.price END AS price "
    "FROM old FULL OUTER JOIN last ON old.k = last.k WHERE coalesce(last.op, 0) <> 2",
)
def merge_hard_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(old_target(spark, sf_dir), orders_log(spark, sf_dir), ["k"], ["status", "price"], mode="record")


@query(
    "merge_soft_delete",
    LOG + LAST + OLD + "SELECT coalesce(last.k, old.k) AS k, CASE WHEN last.k IS NULL OR (last.op = 2 AND old.k IS NOT NULL) THEN old.status ELSE last.status END AS status, "
    "CASE WHEN last.k IS NULL OR last.unchanged = 'price' OR (last.op = 2 AND old.k IS NOT NULL) THEN old.price ELSE last.price END AS price, "
    "coalesce(last.op = 2, false) AS _is_deleted FROM old FULL OUTER JOIN last ON old.k = last.k",
)
def merge_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(old_target(spark, sf_dir), orders_log(spark, sf_dir), ["k"], ["status", "price"], deletes="soft", mode="record")


_COLUMNWISE = LOG + LAST + FOLD + OLD + """SELECT coalesce(s.k, old.k) AS k,
CASE WHEN s.k IS NULL THEN old.status WHEN s.st_at IS NOT NULL AND (s.gone IS NULL OR s.st_at >= s.gone) THEN s.status WHEN s.gone IS NULL THEN old.status END AS status,
CASE WHEN s.k IS NULL THEN old.price WHEN s.pr_at IS NOT NULL AND (s.gone IS NULL OR s.pr_at >= s.gone) THEN s.price WHEN s.gone IS NULL THEN old.price END AS price
FROM old FULL OUTER JOIN s ON old.k = s.k WHERE coalesce(s.op, 0) <> 2"""


@query("merge_unchanged_columns", _COLUMNWISE)
def merge_unchanged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(old_target(spark, sf_dir), orders_log(spark, sf_dir), ["k"], ["status", "price"])


@query("merge_two_batches", _COLUMNWISE)
def merge_two_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log in two batches gives the same target as in one."""
    log = orders_log(spark, sf_dir)
    out = old_target(spark, sf_dir)
    for part in (F.col("batch_id") <= 1, F.col("batch_id") > 1):
        out = merge.merge(out, log.where(part), ["k"], ["status", "price"])
    return out


@query(
    "merge_composite_key",
    f"WITH log AS ({oracle_turns()}), last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos DESC) AS rn FROM log) x WHERE rn = 1) "
    "SELECT conv_id, turn, role, text FROM last WHERE op <> 2",
)
def merge_composite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = turns_log(spark, sf_dir)
    return merge.merge(log.where("false"), log, ["conv_id", "turn"], ["role", "text"])


@query(
    "pk_change_split",
    "WITH moves AS (SELECT o_orderkey AS old_k, o_orderkey + 100000 AS k, o_totalprice AS price, 50000000 + o_orderkey AS pos FROM orders WHERE o_orderkey % 13 = 0) "
    "SELECT old_k AS k, 2 AS op, price, pos FROM moves UNION ALL SELECT k, 0, price, pos FROM moves",
)
def pk_change_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = table(spark, sf_dir, "orders").where("o_orderkey % 13 = 0").selectExpr("o_orderkey AS before_k", "o_orderkey + 100000 AS k", "o_totalprice AS price", "50000000 + o_orderkey AS pos", "0L AS seq", "1 AS op")
    return merge.split_key_changes(moves, ["k"]).select("k", "op", "price", "pos")


@query("batch_range_filter", LOG + "done AS (SELECT 1) SELECT k, op, pos FROM log WHERE batch_id > 0 AND batch_id <= 2")
def batch_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.batch_range(orders_log(spark, sf_dir), 0, 2).select("k", "op", "pos")


_EVENTS = "SELECT event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'error' THEN 10 ELSE 12 END AS op, 'src' || CAST(user_id % 3 AS varchar) AS src_schema, 't' || CAST(user_id % 5 AS varchar) AS src_table FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "error", 10).otherwise(12)
    return table(spark, sf_dir, "events").select("event_id", op.alias("op"), F.concat(F.lit("src"), F.col("user_id") % 3).alias("src_schema"), F.concat(F.lit("t"), F.col("user_id") % 5).alias("src_table"))


@query("data_record_filter", f"SELECT event_id, op FROM ({_EVENTS}) e WHERE op IN (0, 1, 2)")
def data_record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.data_records(_events(spark, sf_dir)).select("event_id", "op")


@query(
    "tracked_table_filter",
    f"SELECT event_id, op, src_schema, src_table FROM ({_EVENTS}) e WHERE (op <> 10 AND src_schema || '.' || src_table IN ('src0.t1', 'src1.t2')) OR (op = 10 AND src_schema IN ('src0', 'src1'))",
)
def tracked_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = spark.createDataFrame([("src0", "t1"), ("src1", "t2")], "src_schema string, src_table string")
    return merge.tracked(_events(spark, sf_dir), tables).select("event_id", "op", "src_schema", "src_table")


@query("internal_table_filter", f"SELECT event_id, src_table FROM ({_EVENTS}) e WHERE substr(src_table, 1, 2) <> 't3'")
def internal_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.without_internal(_events(spark, sf_dir), "t3").select("event_id", "src_table")


@query("distinct_tables", f"SELECT DISTINCT src_schema, src_table FROM ({_EVENTS}) e")
def distinct_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("src_schema", "src_table").distinct()


@query("unchanged_combinations", LOG + "done AS (SELECT 1) SELECT DISTINCT 'orders' AS src_table, coalesce(unchanged, '') AS unchanged FROM log WHERE op <> 2")
def unchanged_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.unchanged_sets(orders_log(spark, sf_dir).withColumn("src_table", F.lit("orders")))


@query("pending_batches", LOG + "done AS (SELECT 1) SELECT batch_id, CAST(count(*) AS bigint) AS n, max(pos) AS last_pos FROM log GROUP BY batch_id")
def pending_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_log(spark, sf_dir).groupBy("batch_id").agg(F.count("*").alias("n"), F.max("pos").alias("last_pos"))


@query(
    "audit_columns",
    LOG + "done AS (SELECT 1) SELECT k, pos, CAST(op AS tinyint) AS _op_type, op = 2 AS _is_deleted, CAST('2026-01-01 00:00:00' AS timestamp) AS _synced_at, CAST(pos AS decimal(20,0)) AS _cdc_version FROM log",
)
def audit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    return merge.with_audit(orders_log(spark, sf_dir), F.col("pos"), now).select("k", "pos", "_op_type", "_is_deleted", "_synced_at", "_cdc_version")


_PLAN = """WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(*) AS n FROM orders),
m AS (SELECT lo, hi, CAST(greatest(1, ceil(n / 1000.0), ceil((hi - lo) / 1000.0)) AS bigint) AS c FROM b),
g AS (SELECT lo, hi, c, unnest(generate_series(0, c - 1)) AS i FROM m),
plan AS (SELECT i AS partition_id, lo + CAST(trunc(CAST(i AS double) * (CAST(hi - lo AS double) / c)) AS bigint) AS start_pk,
CASE WHEN i = c - 1 THEN hi + 1 ELSE lo + CAST(trunc(CAST(i + 1 AS double) * (CAST(hi - lo AS double) / c)) AS bigint) END AS end_pk FROM g),
chunks AS (SELECT * FROM plan WHERE start_pk < end_pk) """


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.plan(snapshot.key_range(table(spark, sf_dir, "orders"), "o_orderkey"), 1000)


@query("chunk_plan", _PLAN + "SELECT partition_id, start_pk, end_pk FROM chunks")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir)


@query("chunk_row_counts", _PLAN + "SELECT partition_id, CAST(count(*) AS bigint) AS n FROM chunks JOIN orders ON o_orderkey >= start_pk AND o_orderkey < end_pk GROUP BY partition_id")
def chunk_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return snapshot.chunk_of(rows, "o_orderkey", _chunks(spark, sf_dir)).groupBy("partition_id").agg(F.count("*").alias("n"))


@query("chunk_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 600")
def chunk_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.scan(table(spark, sf_dir, "orders"), "o_orderkey", 100, 600).select("o_orderkey", "o_totalprice")


_STATE = _PLAN + ", state AS (SELECT 't' || CAST(partition_id % 2 AS varchar) AS table_name, partition_id, start_pk, end_pk, end_pk - start_pk AS rows_synced, CASE partition_id % 3 WHEN 0 THEN 'COMPLETE' WHEN 1 THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status FROM chunks) "


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("partition_id") % 3 == 0, "COMPLETE").when(F.col("partition_id") % 3 == 1, "IN_PROGRESS").otherwise("PENDING")
    return _chunks(spark, sf_dir).select(
        F.concat(F.lit("t"), F.col("partition_id") % 2).alias("table_name"), "partition_id", "start_pk", "end_pk", (F.col("end_pk") - F.col("start_pk")).alias("rows_synced"), status.alias("status"), F.lit(None).cast("decimal(20,0)").alias("hw")
    )


@query("chunk_resume", _STATE + "SELECT table_name, partition_id, start_pk, end_pk FROM state WHERE status <> 'COMPLETE'")
def chunk_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _state(spark, sf_dir)
    return snapshot.to_do(state, state).select("table_name", "partition_id", "start_pk", "end_pk")


_PROGRESS = "SELECT table_name, CAST(count(*) AS bigint) AS chunks, CAST(count(*) FILTER (WHERE status = 'COMPLETE') AS bigint) AS complete, CAST(count(*) FILTER (WHERE status = 'IN_PROGRESS') AS bigint) AS in_progress, CAST(coalesce(sum(rows_synced) FILTER (WHERE status = 'COMPLETE'), 0) AS bigint) AS rows_synced, bool_and(status = 'COMPLETE') AS all_complete FROM {} GROUP BY table_name"


@query("snapshot_progress", _STATE + _PROGRESS.format("state"))
def snapshot_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.progress(_state(spark, sf_dir))


@query("all_chunks_complete", _STATE + "SELECT CAST(count(*) FILTER (WHERE status <> 'COMPLETE') AS bigint) AS open_chunks, count(*) FILTER (WHERE status <> 'COMPLETE') = 0 AS all_complete, CAST(coalesce(sum(rows_synced), 0) AS bigint) AS rows_synced FROM state")
def all_chunks_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_open = F.col("status") != "COMPLETE"
    return _state(spark, sf_dir).agg(F.count_if(is_open).alias("open_chunks"), (F.count_if(is_open) == 0).alias("all_complete"), F.coalesce(F.sum("rows_synced"), F.lit(0)).alias("rows_synced"))


@query(
    "chunk_state_upsert",
    _STATE + ", newer AS (SELECT table_name, partition_id, start_pk, end_pk, rows_synced + 1 AS rows_synced, 'COMPLETE' AS status FROM state WHERE partition_id % 2 = 0), "
    "both_rows AS (SELECT *, 0 AS n FROM state UNION ALL SELECT *, 1 AS n FROM newer), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY table_name, partition_id ORDER BY CASE status WHEN 'COMPLETE' THEN 2 WHEN 'IN_PROGRESS' THEN 1 ELSE 0 END DESC, n DESC) AS rn FROM both_rows) "
    "SELECT table_name, partition_id, rows_synced, status FROM r WHERE rn = 1",
)
def chunk_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _state(spark, sf_dir)
    newer = state.where("partition_id % 2 = 0").withColumn("rows_synced", F.col("rows_synced") + 1).withColumn("status", F.lit("COMPLETE"))
    return snapshot.set_state(state, newer).select("table_name", "partition_id", "rows_synced", "status")


#: Even chunks are finished at this position.
_HW = "15000000 + 1000 * partition_id"


@query(
    "watermark_dedup",
    _PLAN + f", log AS ({oracle_log()}) SELECT k, op, pos FROM log WHERE op = 2 OR NOT EXISTS (SELECT 1 FROM chunks WHERE partition_id % 2 = 0 AND k >= start_pk AND k < end_pk AND pos <= {_HW})",
)
def watermark_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _chunks(spark, sf_dir).where("partition_id % 2 = 0").selectExpr("'orders' AS src_table", "start_pk", "end_pk", f"{_HW} AS hw")
    log = orders_log(spark, sf_dir).withColumn("src_table", F.lit("orders"))
    return reconcile.drop_snapshotted(log, done, "k").select("k", "op", "pos")


@query(
    "snapshot_eviction",
    _PLAN + f", log AS ({oracle_log()}), r AS (SELECT partition_id, o_orderkey AS k, o_totalprice AS price FROM orders JOIN chunks ON o_orderkey >= start_pk AND o_orderkey < end_pk) "
    "SELECT partition_id, k, price FROM r WHERE NOT EXISTS (SELECT 1 FROM log WHERE log.k = r.k AND pos > 10000000 + partition_id AND pos <= 20000000 + 500 * partition_id)",
)
def snapshot_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    windows = chunks.selectExpr("'orders' AS src_table", "*", "10000000 + partition_id AS low", "20000000 + 500 * partition_id AS high")
    log = orders_log(spark, sf_dir).withColumn("src_table", F.lit("orders"))
    rows = snapshot.chunk_of(table(spark, sf_dir, "orders").selectExpr("'orders' AS src_table", "o_orderkey AS k", "o_totalprice AS price"), "k", chunks)
    return reconcile.without_evicted(rows, reconcile.evictions(log, windows, "k"), "k").select("partition_id", "k", "price")


@query(
    "snapshot_union_log",
    f"WITH log AS ({oracle_log()}), b AS (SELECT k, status, price, op, pos, 0 AS seq FROM log UNION ALL SELECT o_orderkey, 'S', o_totalprice, 0, 10000000 + o_orderkey, -1 FROM orders WHERE o_orderkey % 2 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos DESC, seq DESC) AS rn FROM b) SELECT k, op, status, pos, CAST(seq AS bigint) AS seq FROM r WHERE rn = 1",
)
def snapshot_union_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").selectExpr("o_orderkey AS k", "'S' AS status", "o_totalprice AS price", "0 AS op", "10000000 + o_orderkey AS pos")
    both = reconcile.snapshot_and_log(snap, orders_log(spark, sf_dir))
    return merge.latest_by_key(both, ["k"]).select("k", "op", "status", "pos", "seq")


_SETS = [("s1", "u1:1-50:51-100"), ("s2", "u1:1-10:20-30"), ("s3", "u1:1-10,u2:20-30"), ("s4", "u1:1-100000000"), ("s5", ""), ("s6", "u1:5:7-9:8-12:13"), ("s7", "u2:25,u1:3-4")]
_SETS_SQL = "WITH sets AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SETS) + ") v(set_id, gtid)), "
_RUNS_SQL = _SETS_SQL + """parts AS (SELECT set_id, unnest(string_split(gtid, ',')) AS part FROM sets WHERE trim(gtid) <> ''),
bits AS (SELECT set_id, string_split(trim(part), ':')[1] AS uuid, unnest(string_split(trim(part), ':')[2:]) AS run FROM parts),
runs AS (SELECT set_id, uuid, CAST(string_split(run, '-')[1] AS bigint) AS lo, CAST(string_split(run, '-')[-1] AS bigint) AS hi FROM bits),
flagged AS (SELECT *, max(hi) OVER (PARTITION BY set_id, uuid ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM runs),
islands AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY set_id, uuid ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM flagged),
merged AS (SELECT set_id, uuid, min(lo) AS lo, max(hi) AS hi FROM islands GROUP BY set_id, uuid, island) """


def _runs(spark: SparkSession) -> DataFrame:
    return gtid.parse(spark.createDataFrame(_SETS, "set_id string, gtid string"))


@query("gtid_parse", _RUNS_SQL + "SELECT set_id, uuid, lo, hi FROM runs")
def gtid_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark)


@query("gtid_coalesce", _RUNS_SQL + "SELECT set_id, uuid, lo, hi FROM merged")
def gtid_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtid.coalesce(_runs(spark))


@query(
    "gtid_superset",
    _RUNS_SQL + ", pairs AS (SELECT x.set_id AS a, y.set_id AS b FROM sets x, sets y) SELECT a, b, NOT EXISTS (SELECT 1 FROM runs r WHERE r.set_id = b AND NOT EXISTS "
    "(SELECT 1 FROM merged m WHERE m.set_id = a AND m.uuid = r.uuid AND m.lo <= r.lo AND m.hi >= r.hi)) AS is_superset FROM pairs",
)
def gtid_superset(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([(a, b) for a, _ in _SETS for b, _ in _SETS], "a string, b string")
    return gtid.superset(_runs(spark), pairs)


_POINTS_SQL = ", points AS (SELECT 'u' || CAST(1 + event_id % 3 AS varchar) AS uuid, event_id % 120 AS n, event_id FROM events) "


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), 1 + F.col("event_id") % 3).alias("uuid"), (F.col("event_id") % 120).alias("n"), "event_id")


@query(
    "gtid_in_window",
    _RUNS_SQL + _POINTS_SQL + "SELECT uuid, n, event_id FROM points p WHERE EXISTS (SELECT 1 FROM runs r WHERE r.set_id = 's1' AND r.uuid = p.uuid AND p.n BETWEEN r.lo AND r.hi) "
    "AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.set_id = 's2' AND r.uuid = p.uuid AND p.n BETWEEN r.lo AND r.hi)",
)
def gtid_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtid.in_window(_points(spark, sf_dir), _runs(spark), "s2", "s1")


@query("gtid_contains", _RUNS_SQL + _POINTS_SQL + "SELECT uuid, n, event_id FROM points p WHERE EXISTS (SELECT 1 FROM runs r WHERE r.set_id = 's3' AND r.uuid = p.uuid AND p.n BETWEEN r.lo AND r.hi)")
def gtid_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtid.holds(_points(spark, sf_dir), _runs(spark), "s3")


_TEXT = "t AS (SELECT set_id, uuid || ':' || string_agg(CASE WHEN lo = hi THEN CAST(lo AS varchar) ELSE CAST(lo AS varchar) || '-' || CAST(hi AS varchar) END, ':' ORDER BY lo) AS part FROM {} GROUP BY set_id, uuid) SELECT set_id, string_agg(part, ',' ORDER BY part) AS gtid FROM t GROUP BY set_id"


@query("gtid_format", _RUNS_SQL + ", " + _TEXT.format("merged"))
def gtid_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gtid.text(gtid.coalesce(_runs(spark)))


@query(
    "gtid_add",
    _RUNS_SQL.replace("flagged AS (SELECT *, max(hi)", "more AS (SELECT set_id, uuid, lo, hi FROM runs UNION ALL SELECT 's2', 'u1', 31, 31 UNION ALL SELECT 's2', 'u1', 15, 15 UNION ALL SELECT 's5', 'u9', 1, 1), flagged AS (SELECT *, max(hi)").replace("AS before FROM runs)", "AS before FROM more)")
    + ", "
    + _TEXT.format("merged"),
)
def gtid_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.createDataFrame([("s2", "u1", 31), ("s2", "u1", 15), ("s5", "u9", 1)], "set_id string, uuid string, n long")
    return gtid.text(gtid.add(_runs(spark), points))


def _values(spark: SparkSession, texts: list[str | None]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "x string")


def _values_sql(texts: list[str | None]) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(CAST(NULL AS varchar))" if t is None else f"('{t}')" for t in texts) + ") v(x)) v"


_BOOLS = ["t", "T", "true", "TRUE", "1", "f", "false", "0", "yes", "", None]
_NUMBERS = ["1", "-17", "not_a_number", "12.5", "1e3", "", None, "99999999999"]
_MONEY = ["$1,234.56", "€99,95", "-$5.00", "$1,234", "(7)", "12", "", None]
_TSTZ = ["2024-06-15 17:30:00+05:30", "2024-06-15 17:30:00+00", "2024-06-15 17:30:00.25-03", "2024-06-15 17:30:00", "infinity", None]
_LSNS = ["0/0", "0/16B3748", "16/B374D848", "FFFFFFFF/FFFFFFFF", "80000000/1"]


@query("pg_bool", f"SELECT x, lower(x) IN ('t', 'true', '1') AS b FROM {_values_sql(_BOOLS)}")
def pg_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _BOOLS).select("x", scalar.pg_bool(F.col("x")).alias("b"))


@query("pg_numeric_cast", f"SELECT x, CASE WHEN regexp_full_match(x, '-?[0-9]+') THEN TRY_CAST(x AS bigint) END AS i, TRY_CAST(x AS double) AS d FROM {_values_sql(_NUMBERS)}")
def pg_numeric_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _NUMBERS).select("x", F.when(F.col("x").rlike("^-?[0-9]+$"), scalar.pg_number(F.col("x"), "bigint")).alias("i"), scalar.pg_number(F.col("x"), "double").alias("d"))


@query(
    "money_strip",
    "SELECT x, CASE WHEN contains(c, ',') AND contains(c, '.') THEN replace(c, ',', '') WHEN contains(c, ',') THEN substr(c, 1, instr(c, ',') - 1) || '.' || substr(c, instr(c, ',') + 1) ELSE c END AS money "
    f"FROM (SELECT x, regexp_replace(x, '[^0-9.,-]', '', 'g') AS c FROM {_values_sql(_MONEY)}) m",
)
def money_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _MONEY).select("x", scalar.strip_money(F.col("x")).alias("money"))


@query(
    "tstz_normalize",
    "SELECT x, CASE x WHEN '2024-06-15 17:30:00+05:30' THEN '2024-06-15 12:00:00' WHEN '2024-06-15 17:30:00+00' THEN '2024-06-15 17:30:00' WHEN '2024-06-15 17:30:00.25-03' THEN '2024-06-15 20:30:00.250000' ELSE x END AS utc "
    f"FROM {_values_sql(_TSTZ)}",
)
def tstz_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _TSTZ).select("x", scalar.normalize_tstz(F.col("x")).alias("utc"))


@query("micros_to_text", "SELECT event_id, strftime(make_timestamp(event_id % 20000 * 86399999983 - 1000000), '%Y-%m-%d %H:%M:%S.%f') AS t FROM events")
def micros_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalar.micros_text(F.col("event_id") % 20000 * 86399999983 - 1000000).alias("t"))


@query("epoch_to_text", "SELECT event_id, strftime(make_timestamp((1778368097 + event_id) * 1000000), '%Y-%m-%d %H:%M:%S') AS t FROM events")
def epoch_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", scalar.epoch_text((F.col("event_id") + 1778368097).cast("string")).alias("t"))


@query("bytes_hex", "SELECT event_id, lower(hex(encode(event_type || props))) AS h, event_type || props AS back FROM events")
def bytes_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = scalar.bytes_hex(F.concat("event_type", "props").cast("binary"))
    return table(spark, sf_dir, "events").select("event_id", h.alias("h"), F.decode(scalar.hex_bytes(h), "UTF-8").alias("back"))


@query("lsn_roundtrip", "SELECT x, CAST(n AS decimal(20,0)) AS n, x AS back FROM (VALUES ('0/0', 0::hugeint), ('0/16B3748', 23803720), ('16/B374D848', 97500059720), ('FFFFFFFF/FFFFFFFF', 18446744073709551615), ('80000000/1', 9223372036854775809)) v(x, n)")
def lsn_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scalar.lsn_number(F.col("x"))
    return _values(spark, _LSNS).select("x", n.alias("n"), scalar.lsn_text(n).alias("back"))


_ARRAYS = ["{}", "{1,2,3}", "{NULL,1,2}", '{"a b",c}', "{NaN}", "plain", None]


@query("pg_array_parse", "SELECT x, j FROM (VALUES ('{}', '[]'), ('{1,2,3}', '[1,2,3]'), ('{NULL,1,2}', '[null,1,2]'), ('{\"a b\",c}', '[\"a b\",\"c\"]'), ('{NaN}', '[\"NaN\"]'), ('plain', '\"plain\"'), (NULL, NULL)) v(x, j)")
def pg_array_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, _ARRAYS).select("x", scalar.pg_array("int")(F.col("x")).alias("j"))


@query("json_projection", "SELECT event_id, CAST(props ->> '$.k' AS bigint) AS k FROM events")
def json_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", raw.extract_variant(F.col("props"), "k", "Int64").alias("k"))


_IMAGE = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS c_name, c_nationkey FROM customer"


@query("json_build", f"SELECT c_custkey, c_name, CAST(c_nationkey AS bigint) AS c_nationkey, false AS has_name FROM ({_IMAGE}) i WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, CAST(c_nationkey AS bigint), true FROM ({_IMAGE}) i WHERE c_custkey % 2 = 1")
def json_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row images as JSON and back; names of even customers are left out as unchanged, those of every fourth are null."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("c_name"), "c_nationkey")
    left_out = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("c_name"))).otherwise(F.array().cast("array<string>"))
    short = rows.select("c_name", scalar.image_json(["c_custkey", "c_name", "c_nationkey"]).alias("whole"), scalar.image_json(["c_custkey", "c_name", "c_nationkey"], left_out).alias("image"))
    back = F.from_json("whole", "c_custkey bigint, c_name string, c_nationkey bigint")
    return short.select(back["c_custkey"].alias("c_custkey"), back["c_name"].alias("c_name"), back["c_nationkey"].alias("c_nationkey"), F.array_contains(F.json_object_keys("image"), "c_name").alias("has_name"))


_CACHED = [("orders", "id", "Int32", 23), ("orders", "name", "String", 25), ("orders", "amount", "Decimal", 1700), ("items", "id", "Int64", None)]
_INCOMING = [("orders", "id", "Int64", 20), ("orders", "amount", "Decimal", 1700), ("orders", "description", "String", 25), ("items", "id", "Int64", 20), ("fresh", "id", "Int32", 23)]
_row = lambda r: "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")"
_COLUMNS = "table_name string, column_name string, data_type string, oid int"
_SCHEMA_SQL = "WITH a AS (SELECT * FROM (VALUES " + ", ".join(map(_row, _CACHED)) + ") v(t, c, d, o)), b AS (SELECT * FROM (VALUES " + ", ".join(map(_row, _INCOMING)) + ") v(t, c, d, o)) "


@query(
    "schema_diff",
    _SCHEMA_SQL + "SELECT * FROM (SELECT coalesce(a.t, b.t) AS table_name, coalesce(a.c, b.c) AS column_name, CASE WHEN a.d IS NULL THEN 'added' WHEN b.d IS NULL THEN 'dropped' WHEN a.d <> b.d OR coalesce(a.o <> b.o, false) THEN 'type_changed' END AS change, a.d AS old_type, b.d AS new_type FROM a FULL OUTER JOIN b ON a.t = b.t AND a.c = b.c) x WHERE change IS NOT NULL",
)
def schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.diff(spark.createDataFrame(_CACHED, _COLUMNS), spark.createDataFrame(_INCOMING, _COLUMNS))


@query("missing_target_columns", _SCHEMA_SQL + "SELECT upper(t) AS table_name, upper(c) AS column_name FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.t = b.t AND lower(a.c) = lower(b.c))")
def missing_target_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.createDataFrame(_INCOMING, _COLUMNS).withColumn("column_name", F.upper("column_name"))
    return schema.missing(source, spark.createDataFrame(_CACHED, _COLUMNS)).select(F.upper("table_name").alias("table_name"), "column_name")


@query(
    "last_position",
    f"WITH e AS ({_EVENTS}), r AS (SELECT src_table, event_id AS pos, op FROM e WHERE op NOT IN (10, 11)) SELECT src_table, max(pos) AS pos FROM r GROUP BY src_table",
)
def last_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.last_position(_events(spark, sf_dir).withColumn("pos", F.col("event_id")).withColumn("seq", F.lit(0))).select("src_table", "pos")


@query("lag_ms", "SELECT event_id, greatest(0, 1706745600000 - (epoch_us(ts) - 946684800000000 + event_id % 7 + 946684800000000) // 1000) AS lag FROM events")
def lag_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    commit = F.unix_micros(F.col("ts").cast("timestamp")) - scalar.PG_EPOCH_MICROS + F.col("event_id") % 7
    return table(spark, sf_dir, "events").select("event_id", scalar.lag_ms(commit, F.lit(1706745600000).cast("bigint")).alias("lag"))


@query("monotone_pointer", LOG + "done AS (SELECT 1) SELECT batch_id, max(max(pos)) OVER (ORDER BY batch_id) AS pointer FROM log GROUP BY batch_id")
def monotone_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.pointers(orders_log(spark, sf_dir))


_CATALOG = [("orders", "note", "String", None), ("orders", "id", "Int64", 2), ("orders", "code", "String", 1), ("items", "qty", "Int32", None), ("items", "item_id", "Int32", 2), ("items", "order_id", "Int64", 1), ("tags", "name", "String", 1)]


@query("catalog_pk_order", "SELECT table_name, arg_min(column_name, key_place) AS column_name FROM (VALUES " + ", ".join(map(_row, _CATALOG)) + ") v(table_name, column_name, data_type, key_place) WHERE key_place IS NOT NULL AND data_type IN ('Int16', 'Int32', 'Int64') GROUP BY table_name")
def catalog_pk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.integer_key(spark.createDataFrame(_CATALOG, "table_name string, column_name string, data_type string, key_place int"))


@query("publication_missing_tables", "SELECT n_name AS table_name FROM nation WHERE 'public.' || n_name NOT IN (SELECT 'public.' || n_name FROM nation WHERE n_nationkey % 3 = 0)")
def publication_missing_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("table_name"), "n_nationkey")
    return raw.missing_tables(names.drop("n_nationkey"), names.where("n_nationkey % 3 = 0"))


@query("job_names", "SELECT n_name, regexp_replace(n_name || '-job.1', '[^A-Za-z0-9]', '_', 'g') AS job, upper(regexp_replace(n_name || '-job.1', '[^A-Za-z0-9]', '_', 'g')) AS upper_job FROM nation")
def job_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("n_name", F.lit("-job.1"))
    return table(spark, sf_dir, "nation").select("n_name", scalar.job_name(name).alias("job"), scalar.job_name(name, upper=True).alias("upper_job"))
