"""Queries over literal rows and derived logs for the operators that no table shows, with SQL whose rows are written out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.errors import PositionGap
from changeloom.functions import scalar, types
from changeloom.operators import active, gtid, merge, raw, schema, snapshot
from changeloom.plans.changelog import batch_ids, orders_log, recorded, table
from changeloom.plans.queries import FOLD, LAST, LOG, query
from changeloom.plans.staged import ROWS
from changeloom.plans.streamed import _RESULT, envelope
from changeloom.sources import binlog, pgoutput, registry
from changeloom.streaming import control, restart
from changeloom.streaming.backfill import copy
from changeloom.streaming.sinks import RawParquet, drain
from changeloom.streaming.snapshot_run import SnapshotRun
from changeloom.streaming.store import Target, shared_dir

_SQL_KIND = {"string": "varchar", "long": "bigint", "boolean": "boolean", "double": "double"}


def _literal(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(kind: str, rows: list[tuple]) -> str:
    """SQL of rows that are written out."""
    cols = [c.split() for c in kind.split(", ")]
    said = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST({n} AS {_SQL_KIND[t]}) AS {n}" for n, t in cols) + f" FROM (VALUES {said}) v({', '.join(n for n, _ in cols)})"


def expects(name: str, kind: str, want: list[tuple]):
    """Register a function that gives rows of the kind; the oracle has the rows as they are written here."""

    def of(f: Callable[[], list[tuple]]):
        query(name, values(kind, want))(lambda spark, sf_dir: spark.createDataFrame(list(f()), kind))
        return f

    return of


# Functions over single values.


@expects("quoted_names", "name string, back string, double string", [("orders", "`orders`", '"orders"'), ("a.b", "`a`.`b`", '"a"."b"'), ("we`ird", "`we``ird`", '"we`ird"'), ('q"t', '`q"t`', '"q""t"')])
def quoted_names():
    return [(n, types.quote(n), types.quote(n, '"')) for n in ("orders", "a.b", "we`ird", 'q"t')]


@expects("split_tables", "name string, head string, tail string", [("shop.orders", "shop", "orders"), ("orders", "public", "orders"), ("a.b.c", "a", "b.c")])
def split_tables():
    return [(n, *types.split_table(n)) for n in ("shop.orders", "orders", "a.b.c")]


@expects(
    "source_types",
    "source string, code string, data_type string",
    [("pg", "16", "Boolean"), ("pg", "20", "Int64"), ("pg", "1700", "Decimal"), ("pg", "1184", "TimestampTz"), ("pg", "99999", "String"), ("mysql", "int(11) unsigned", "Int32"), ("mysql", "TINYINT", "Int16"), ("mysql", "decimal(10,2)", "Decimal"), ("mysql", "timestamp", "TimestampTz"), ("mysql", "datetime(6)", "Timestamp"), ("mysql", "whatever", "String")],
)
def source_types():
    return [("pg", str(o), types.from_pg(o)) for o in (16, 20, 1700, 1184, 99999)] + [("mysql", n, types.from_mysql(n)) for n in ("int(11) unsigned", "TINYINT", "decimal(10,2)", "timestamp", "datetime(6)", "whatever")]


@expects("decimal_clamp", "p long, s long, p2 long, s2 long", [(10, 2, 10, 2), (50, 9, 38, 9), (60, 50, 38, 38), (5, 9, 5, 5)])
def decimal_clamp():
    return [(p, s, *types.clamp_decimal(p, s)) for p, s in ((10, 2), (50, 9), (60, 50), (5, 9))]


@expects("integer_key_types", "kind string, fits boolean", [("smallint", True), ("int", True), ("bigint", True), ("string", False), ("double", False), ("decimal(10,0)", False)])
def integer_key_types():
    return [(k, types.is_integer_key(T._parse_datatype_string(k))) for k in ("smallint", "int", "bigint", "string", "double", "decimal(10,0)")]


@expects("clean_address", "url string", [("postgres://u@h/db",), ("postgres://u@h/db?sslmode=require",), ("postgres://u@h/db?a=1&b=2",)])
def clean_address():
    return [(registry.without_parameter(u),) for u in ("postgres://u@h/db?replication=database", "postgres://u@h/db?replication=database&sslmode=require", "postgres://u@h/db?a=1&replication=x&b=2")]


@expects("query_words", "text string, kind string", [("BEGIN", "begin"), ("commit;", "commit"), ("ROLLBACK", "rollback"), ("ALTER TABLE t ADD c int", "ddl"), ("  begin", "begin"), ("", "ddl")])
def query_words():
    return [(t, binlog.query_kind(t)) for t in ("BEGIN", "commit;", "ROLLBACK", "ALTER TABLE t ADD c int", "  begin", "")]


@expects("gtid_of_bytes", "gtid string", [("00010203-0405-0607-0809-0a0b0c0d0e0f:7",), ("ffffffff-ffff-ffff-ffff-ffffffffffff:1",)])
def gtid_of_bytes():
    return [(binlog.gtid_text(bytes(range(16)), 7),), (binlog.gtid_text(b"\xff" * 16, 1),)]


@expects("resume_points", "n long, gtid string", [(1, "u:1-5"), (2, None), (3, None), (4, None)])
def resume_points():
    positions = [{"pos_kind": "binlog", "pos_gtid": "u:1-5"}, {"pos_kind": "binlog", "pos_gtid": " "}, {"pos_kind": "lsn", "pos_gtid": "u:1-5"}, None]
    return [(k + 1, binlog.resume_point(p)) for k, p in enumerate(positions)]


@expects("status_frame", "hex string, size long", [("72" + "000000000000000a" + "0000000000000009" + "0000000000000008" + "0000000000000007" + "01", 34)])
def status_frame():
    data = pgoutput.status_reply(10, 9, 8, 7, True)
    return [(data.hex(), len(data))]


@expects("batch_choice", "sink string, batch long, interval_ms long", [("postgres", 250000, 10000), ("starrocks", 100000, 5000), ("snowflake", 500000, 30000), ("other", 10000, 5000), ("set", 77, 88)])
def batch_choice():
    base = {"CHANGELOOM_SOURCE": "s", "CHANGELOOM_TARGET": "t", "CHANGELOOM_TABLES": "a"}
    made = {s: control.Config.from_env(base | {"CHANGELOOM_SINK": s}) for s in ("postgres", "starrocks", "snowflake", "other")}
    made["set"] = control.Config.from_env(base | {"CHANGELOOM_SINK": "postgres", "CHANGELOOM_BATCH": "77", "CHANGELOOM_INTERVAL_MS": "88"})
    return [(s, c.batch, c.interval_ms) for s, c in made.items()]


@expects("evolution_plan", "place long, table_name string, column_name string, kind string", [(0, "t", "d", "String"), (1, "u", "x", "Date"), (2, "t", "e", "Int32")])
def evolution_plan():
    changes = [("t", {"id": "Int64", "d": "String"}), ("t", {"d": "String"}), ("u", {"x": "Date"}), ("t", {"e": "Int32"})]
    return [(k, *p) for k, p in enumerate(schema.plan({"t": {"id": "Int32"}}, changes))]


@expects("start_reconcile", "what string, name string", [("add", "n"), ("dropped", "old")])
def start_reconcile():
    known, source = (T._parse_datatype_string(x) for x in ("k long, old string", "k long, n int"))
    add, gone = schema.reconcile(known, source)
    return [("add", f.name) for f in add if f.nullable] + [("dropped", n) for n in gone]


# Decoders.


@expects(
    "wire_messages",
    "kind string, lsn long, xid long, reply boolean",
    [("begin", 500, 42, False), ("commit", 600, 0, False), ("keepalive", 700, 0, True), ("logical", 800, 0, False), ("unknown", 900, 0, False), ("short", None, None, None)],
)
def wire_messages():
    import struct

    frames = [
        pgoutput.frame(b"B" + struct.pack(">QqI", 500, 1, 42), 9), pgoutput.frame(b"C" + struct.pack(">BQQq", 0, 550, 600, 2), 9), b"k" + struct.pack(">QQB", 700, 5, 1),
        pgoutput.frame(b"M" + bytes(20), 800), pgoutput.frame(b"?", 900), b"w123",
    ]
    found = [pgoutput.decode_frame(f) for f in frames]
    return [(m.kind, m.lsn, m.xid, m.reply) if m else ("short", None, None, None) for m in found]


@expects(
    "binlog_rows",
    "seq long, op long, tab string, before string, after string, gtid string",
    [(1, 11, None, None, None, "00010203-0405-0607-0809-0a0b0c0d0e0f:7"), (2, 0, "orders", None, '{"id":1,"at":"2026-05-09 23:08:17"}', "00010203-0405-0607-0809-0a0b0c0d0e0f:7"), (3, 1, "orders", '{"id":1,"at":null}', '{"id":2}', "00010203-0405-0607-0809-0a0b0c0d0e0f:7"), (4, 2, "orders", '{"id":2,"at":null}', None, "00010203-0405-0607-0809-0a0b0c0d0e0f:7"), (5, 12, None, None, None, "00010203-0405-0607-0809-0a0b0c0d0e0f:7")],
)
def binlog_rows():
    events = [
        {"type": "rotate", "file": "log.1"}, {"type": "gtid", "sid": bytes(range(16)), "number": 7}, {"type": "query", "text": "BEGIN", "pos": 1},
        {"type": "table_map", "id": 3, "schema": "shop", "table": "orders", "columns": ["id", "at"], "types": ["INT", "TIMESTAMP"]},
        {"type": "write", "id": 3, "rows": [[1, 1778368097]], "pos": 2}, {"type": "update", "id": 3, "rows": [([1, None], [2])], "pos": 3}, {"type": "delete", "id": 3, "rows": [[2, None]], "pos": 4}, {"type": "xid", "pos": 5},
    ]
    return [(r["seq"], r["op"], r.get("src_table"), r.get("before"), r.get("after"), r["pos_gtid"]) for r in binlog.envelope(events)]


# Column expressions over tables.


@query(
    "position_texts",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN '0/' || upper(hex(event_id)) WHEN 1 THEN CAST(event_id AS varchar) WHEN 2 THEN 'log.1:' || event_id WHEN 3 THEN 'u:1-' || event_id ELSE 'log.1:' || event_id || ':u:1-' || event_id END AS said, "
    "CASE WHEN event_id % 5 IN (0, 1) THEN event_id > 5000 WHEN event_id % 5 IN (2, 4) THEN event_id > 5000 END AS ahead FROM events",
)
def position_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a position of one of five kinds, and whether it is ahead of number 5,000 of its kind."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("lsn", "offset", "file", "gtid", "binlog")]), (F.col("event_id") % 5 + 1).cast("int"))
    pos, mark = F.col("event_id").cast("decimal(20,0)"), F.lit(5000).cast("decimal(20,0)")
    said = scalar.position_text(kind, pos, F.lit("log.1"), F.concat(F.lit("u:1-"), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", said.alias("said"), scalar.position_ahead(kind, pos, kind, mark, F.lit("log.1"), F.lit("log.1")).alias("ahead"))


@query("server_versions", "SELECT event_id, event_id % 7 > 3 OR (event_id % 7 = 3 AND event_id % 4 >= 2) AS recent FROM events")
def server_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("engine-%d.%d.9 build", F.col("event_id") % 7, F.col("event_id") % 4)
    return table(spark, sf_dir, "events").select("event_id", scalar.version_at_least(text, 3, 2).alias("recent"))


@query("table_properties", "SELECT event_id, event_id % 3 <> 2 AS fast FROM events")
def table_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    ddl = F.element_at(F.array(F.lit('"Fast_Evolution" = "TRUE"'), F.lit("fast_evolution:true"), F.lit('"fast_evolution" = "false"')), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scalar.has_property(ddl, "fast_evolution", "true").alias("fast"))


@query("key_texts", "SELECT event_id, 'i:' || event_id AS number_key, 's:' || event_id AS text_key FROM events")
def key_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", active.key_text(F.col("event_id"), "bigint").alias("number_key"), active.key_text(F.col("event_id").cast("string"), "string").alias("text_key"))


@query("keys_in_range", "SELECT event_id, event_id BETWEEN 90 AND 1000 AS by_number, 'k' || event_id BETWEEN 'k200' AND 'k3' AS by_text FROM events")
def keys_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    return table(spark, sf_dir, "events").select("event_id", active.in_range(n, F.lit("90"), F.lit("1000")).alias("by_number"), active.in_range(F.concat(F.lit("k"), n), F.lit("k200"), F.lit("k3")).alias("by_text"))


@query(
    "variant_extraction",
    "SELECT c_custkey, c_name AS b, CAST(c_acctbal AS decimal(12,2)) AS money, CAST(NULL AS decimal(12,2)) AS no_number, '[' || c_custkey || ',2]' AS arr, CAST(c_nationkey AS bigint) AS n FROM customer",
)
def variant_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row images with bytes as base64, money texts, arrays and numbers as text, by the type of each column."""
    image = F.to_json(F.struct(F.base64(F.col("c_name").cast("binary")).alias("b"), F.concat(F.lit("$"), F.format_string("%.2f", "c_acctbal")).alias("m"), F.lit("many").alias("d"), F.concat(F.lit("["), F.col("c_custkey").cast("string"), F.lit(",2]")).alias("a"), F.col("c_nationkey").cast("string").alias("n")))
    x = lambda *a, **k: raw.extract_variant(F.col("image"), *a, **k)
    rows = table(spark, sf_dir, "customer").select("c_custkey", image.alias("image"))
    money = x("m", "Decimal", raw.MONEY_OID, 12, 2)
    return rows.select("c_custkey", F.decode(x("b", "Bytes"), "UTF-8").alias("b"), money.alias("money"), x("d", "Decimal", None, 12, 2).alias("no_number"), x("a", "String", 1007).alias("arr"), x("n", "Int64").alias("n"))


@query("envelope_ends", LOG + "done AS (SELECT 1) SELECT op, CAST(count(*) AS bigint) AS n, CAST(min(pos) AS bigint) AS lo, CAST(max(pos) AS bigint) AS hi FROM log GROUP BY op")
def envelope_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = merge.data_records(envelope(orders_log(spark, sf_dir)))
    return log.groupBy(F.col("op").cast("int").alias("op")).agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("lo"), F.max("pos").cast("long").alias("hi"))


@query(
    "chunk_plan_range",
    "WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), c AS (SELECT *, greatest(1, CAST(ceil((hi - lo) / 700.0) AS bigint)) AS chunks FROM b), p AS (SELECT *, unnest(range(chunks)) AS k FROM c) "
    "SELECT k AS partition_id, lo + CAST(floor(k * ((hi - lo) / CAST(chunks AS double))) AS bigint) AS start_pk, CASE WHEN k = chunks - 1 THEN hi + 1 ELSE lo + CAST(floor((k + 1) * ((hi - lo) / CAST(chunks AS double))) AS bigint) END AS end_pk FROM p",
)
def chunk_plan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by the key's range alone."""
    return snapshot.plan(snapshot.key_range(table(spark, sf_dir, "orders"), "o_orderkey"), 700, estimate=False).select("partition_id", "start_pk", "end_pk")


@query("gtid_empty_sets", values("set_id string, is_empty boolean", [("a", False), ("b", True), ("c", True)]))
def gtid_empty_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.createDataFrame([("a", "u:1-5"), ("b", ""), ("c", "  ")], "set_id string, gtid string")
    return sets.join(gtid.parse(sets).select("set_id").distinct().withColumn("held", F.lit(True)), "set_id", "left").select("set_id", F.col("held").isNull().alias("is_empty"))


# Targets: order, splits, interruptions.

#: The fold with soft deletes: deleted keys stay with their old image.
_SOFT = LOG + LAST + FOLD + """del AS (SELECT * FROM (SELECT k, status, price, row_number() OVER (PARTITION BY k ORDER BY pos DESC) AS rn FROM log WHERE op = 2) x WHERE rn = 1)
SELECT s.k, CASE WHEN s.op = 2 THEN del.status WHEN st_at IS NOT NULL AND (gone IS NULL OR st_at >= gone) THEN s.status END AS status,
CASE WHEN s.op = 2 THEN del.price WHEN pr_at IS NOT NULL AND (gone IS NULL OR pr_at >= gone) THEN s.price END AS price, s.op = 2 AS _is_deleted FROM s LEFT JOIN del ON del.k = s.k"""


@query("merge_soft_split", _SOFT)
def merge_soft_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in its batches, the last ones first, into a target with soft deletes: deleted rows carry the full old image."""
    base = shared_dir(spark, "split")
    target = Target(spark, f"{base}/target", ROWS, ["k"], deletes="soft")
    log = recorded(orders_log(spark, sf_dir), f"{base}/recorded")
    for place, k in enumerate(reversed(batch_ids(log))):
        target.apply(log.where(F.col("batch_id") == k).drop("batch_id"), place)
    return target.read()


def _table_at(log: DataFrame, pos: int) -> DataFrame:
    """The table as it was at a position of its log. A log of some keys gives the rows of those. They stay dealt out by key, so that a target takes them with no other shuffle."""
    return merge.visible(merge.state_of(log.where(F.col("pos") <= pos), ["k"], ["status", "price"]), ["k"], ["status", "price"])


@query("backfill_after_log", _RESULT)
def backfill_after_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log first, then a backfill of the table as of an earlier position: newer log rows win, deleted keys stay away."""
    target = Target(spark, f"{shared_dir(spark, 'late')}/target", ROWS, ["k"])
    log = orders_log(spark, sf_dir)
    target.apply(log.drop("batch_id"), 0)
    copy(_table_at(log, 15_000_000), target, 15_000_000, 0)
    return target.read()


@query("snapshot_run", _RESULT)
def snapshot_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concurrent snapshot in waves of two chunks while log batches arrive; the third wave fails once, and another run resumes from the state."""
    base = shared_dir(spark, "run")
    log = recorded(orders_log(spark, sf_dir), f"{base}/recorded")
    target, marks, failed = Target(spark, f"{base}/target", ROWS, ["k"]), [0], []
    target.apply(log.where("batch_id = 0").drop("batch_id"), 0)

    def mark() -> int:
        marks.append(min(marks[-1] + 4_000_000, 60_000_000))
        return marks[-1]

    def read(start: int, end: int) -> DataFrame:
        if len(marks) > 5 and not failed:
            failed.append(True)
            raise OSError("the connection was lost")
        return _table_at(snapshot.scan(log, "k", start, end), marks[-1] + 2_000_000)

    changes = lambda low, high: log.where((F.col("pos") > low) & (F.col("pos") <= high))
    bounds = snapshot.key_range(table(spark, sf_dir, "orders"), "o_orderkey")
    size = (bounds.select((F.col("hi") - F.col("lo") + 8).alias("n")).first().n or 8) // 8
    for _ in range(2):
        run = SnapshotRun(spark, f"{base}/state", "orders", target, "k", wave=2)
        run.prepare(bounds, size)
        try:
            run.run(read, mark, changes)
        except OSError:
            continue
    for k in [k for k in batch_ids(log) if k > 0]:
        target.apply(log.where(F.col("batch_id") == k).drop("batch_id"), k)
    return target.read()


@query("snapshot_again", _RESULT)
def snapshot_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot that is forgotten after its table was copied and taken again at a later mark, then the log's batches."""
    base = shared_dir(spark, "again")
    log = recorded(orders_log(spark, sf_dir), f"{base}/recorded")
    target = Target(spark, f"{base}/target", ROWS, ["k"])
    bounds = snapshot.key_range(table(spark, sf_dir, "orders"), "o_orderkey")
    for place, pos in enumerate((5_000_000, 15_000_000)):
        run = SnapshotRun(spark, f"{base}/state", "orders", target, "k", wave=2)
        if place:
            run.forget()
        run.prepare(bounds, (bounds.select((F.col("hi") - F.col("lo") + 4).alias("n")).first().n or 4) // 4)
        run.run(lambda start, end, pos=pos: _table_at(snapshot.scan(log, "k", start, end), pos), lambda pos=pos: pos)
    for k in batch_ids(log):
        target.apply(log.where(F.col("batch_id") == k).drop("batch_id"), k)
    return target.read()


@query("restart_positions", values("stored string, goes_on boolean", [("u:1-5,v:3", True), ("u:1-9", False), ("u:2-5,v:3", False), ("", False)]))
def restart_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored sets against a source that purged u:1-4 and v:3: one holds them, two lack some, one is no position."""
    rows = []
    for stored in ("u:1-5,v:3", "u:1-9", "u:2-5,v:3", ""):
        try:
            rows.append((stored, restart.check_position(spark, stored, "u:1-4,v:3")))
        except PositionGap:
            rows.append((stored, False))
    return spark.createDataFrame(rows, "stored string, goes_on boolean")


@query("restart_columns", "SELECT c_custkey, c_name, CAST(NULL AS varchar) AS note FROM customer")
def restart_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target whose source got a column and dropped another while the job was down."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")
    path = f"{shared_dir(spark, 'columns')}/target"
    target = Target(spark, path, rows.schema, ["c_custkey"])
    copy(rows, target, 1, 0)
    restart.reconcile_target(target, T._parse_datatype_string("c_custkey long, note string"))
    return Target(spark, path, rows.schema, ["c_custkey"]).read()


@query("staged_drain_retry", _RESULT)
def staged_drain_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged batches drained into a target that fails once before and once after a publication."""
    base = shared_dir(spark, "retry")
    staged, log = RawParquet(spark, f"{base}/raw"), envelope(recorded(orders_log(spark, sf_dir), f"{base}/recorded"))
    for k in batch_ids(log):
        staged.write(log.where(F.col("batch_id") == k), k)

    class Failing(Target):
        calls = 0

        def apply(self, log: DataFrame, batch: int, feed: str = "log") -> bool:
            self.calls += 1
            if self.calls == 2:
                raise OSError("before the publication")
            out = super().apply(log, batch, feed)
            if self.calls == 4:
                raise OSError("after the publication")
            return out

    target = Failing(spark, f"{base}/target", ROWS, ["k"])
    drain(staged, {"shop.orders": target}, wait=0.01)
    return target.read()
