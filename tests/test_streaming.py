"""Targets, the normaliser, schema changes, control."""

import json
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.errors import ConfigError, SchemaError
from changeloom.model import ENVELOPE
from changeloom.operators import schema
from changeloom.streaming.backfill import chunks_of, copy
from changeloom.streaming.control import Config, Job, Stopped
from changeloom.streaming.normalize import Normalizer, run
from changeloom.streaming.store import Target

LOG = "k long, v string, op int, pos decimal(20,0), seq long, unchanged array<string>"


def target(spark, path, **more):
    return Target(spark, f"file://{path}/t", spark.createDataFrame([], "k long, v string").schema, ["k"], **more)


def rows(spark, *r):
    from decimal import Decimal

    return spark.createDataFrame([(k, v, op, Decimal(pos), 0, []) for k, v, op, pos in r], LOG)


def test_publish_replay_and_restart(spark, tmp_path):
    t = target(spark, tmp_path)
    assert t.apply(rows(spark, (1, "a", 0, 1), (2, "b", 0, 2)), 0)
    assert not t.apply(rows(spark, (1, "zzz", 1, 9)), 0)  # published before
    again = target(spark, tmp_path)  # a restart
    assert again.apply(rows(spark, (1, None, 2, 3)), 1) and again.state["pos"] == 3
    assert [tuple(r) for r in again.read().collect()] == [(2, "b")]


def test_a_batch_writes_its_own_rows_only(spark, tmp_path):
    t = target(spark, tmp_path)
    t.apply(rows(spark, *[(k, "x", 0, k) for k in range(40)]), 0)
    t.apply(rows(spark, (7, "y", 1, 99)), 1)
    last = t.state["parts"][-1]["folder"]
    assert spark.read.parquet(f"{t.path}/{last}").count() == 1 and t.read().count() == 40
    for k in range(2, 12):
        t.apply(rows(spark, (k, "z", 1, 100 + k)), k)
    assert len(t.state["parts"]) < 6 and {r.k: r.v for r in t.read().collect()} == {k: "z" if 2 <= k < 12 else "x" for k in range(40)}


def test_any_order_of_batches_and_chunks(spark, tmp_path):
    """Log batches and backfilled chunks that arrive in any order give the same table; a chunk doesn't overwrite newer log rows."""
    import itertools

    source = spark.createDataFrame([(k, "snap") for k in range(6)], "k long, v string")
    steps = [("log", rows(spark, (1, "old", 1, 40), (2, None, 2, 60))), ("log", rows(spark, (3, "log", 1, 100), (4, None, 2, 30), (9, "new", 0, 101))), ("chunk", source)]
    want = {0: "snap", 1: "snap", 3: "log", 4: "snap", 5: "snap", 9: "new"}
    for n, order in enumerate(itertools.permutations(steps)):
        t = target(spark, tmp_path / str(n))
        for k, (kind, what) in enumerate(order):
            assert copy(what, t, 50, k) if kind == "chunk" else t.apply(what, k)
        assert {r.k: r.v for r in t.read().collect()} == want
    t.forget(1000)
    t.compact(every=True)
    assert {r.k: r.v for r in t.read().collect()} == want and spark.read.parquet(f"{t.path}/{t.state['parts'][0]['folder']}").count() == len(want)


def test_malformed_images_stop_the_batch(spark, tmp_path):
    for bad in ('{"k":2,"v":', '{"k":"x","v":"b"}', '{"v":"b"}'):
        log = envelope(spark, (0, None, {"k": 1, "v": "a"}, [], 1)).withColumn("after", F.lit(bad))
        with pytest.raises(Exception, match="MALFORMED|CANNOT_PARSE|without a key"):
            Normalizer({"s.t": target(spark, tmp_path)})(log, 0)


def test_a_new_schema_at_start_adds_its_columns(spark, tmp_path):
    target(spark, tmp_path).apply(rows(spark, (1, "a", 0, 1)), 0)
    wider = Target(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "k long, v string, w int").schema, ["k"])
    assert [tuple(r) for r in wider.read().collect()] == [(1, "a", None)]


def test_unpublished_attempt_is_overwritten(spark, tmp_path):
    t = target(spark, tmp_path)
    rows(spark, (5, "lost", 0, 1)).write.parquet(f"file://{tmp_path}/t/v=00000001")
    t.apply(rows(spark, (1, "a", 0, 1)), 0)
    assert [tuple(r) for r in t.read().collect()] == [(1, "a")]


def envelope(spark, *r):
    from decimal import Decimal

    full = [("s", "t", op, b and json.dumps(b), a and json.dumps(a), u, "lsn", Decimal(pos), None, None, pos, None, 1, False, 0) for op, b, a, u, pos in r]
    return spark.createDataFrame(full, ENVELOPE)


def test_normaliser_with_key_change_unsent_columns_and_new_column(spark, tmp_path):
    t = target(spark, tmp_path)
    n = Normalizer({"s.t": t})
    n(envelope(spark, (0, None, {"k": 1, "v": "a"}, [], 1), (0, None, {"k": 2, "v": "b"}, [], 2)), 0)
    described = json.dumps([{"name": c, "type": x} for c, x in (("k", "Int64"), ("v", "String"), ("w", "Int32"))])
    change = envelope(spark, (10, None, None, None, 3)).withColumn("after", F.lit(described))
    n(change.unionByName(envelope(spark, (1, {"k": 1, "v": "a"}, {"k": 9}, ["v"], 4), (1, None, {"k": 2, "w": 5}, ["v"], 5))), 1)
    assert sorted(tuple(r) for r in t.read().collect()) == [(2, "b", 5), (9, "a", None)]
    assert n.job.status()["batches"] == 2


def test_snapshot_loses_to_later_log(spark, tmp_path):
    t = target(spark, tmp_path)
    source = spark.createDataFrame([(k, "snap") for k in range(10)], "k long, v string")
    assert chunks_of(source, "k", 3).count() == 4
    copy(source, t, 100, 0)
    t.apply(rows(spark, (3, "log", 1, 101)), 1)
    assert {r.k: r.v for r in t.read().collect()} == {k: "log" if k == 3 else "snap" for k in range(10)}
    with pytest.raises(SchemaError):
        chunks_of(source, "v", 3)


def test_schema_plan_folds_repeats():
    assert schema.plan({"t": {"id": "Int32"}}, [("t", {"id": "Int64", "d": "String"}), ("t", {"d": "String"}), ("u", {"x": "Date"})]) == [("t", "d", "String"), ("u", "x", "Date")]


def test_schema_evolve_and_reconcile(spark):
    new = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.StringType())])
    out = schema.evolve(spark.createDataFrame([(1,)], "k long"), new)
    assert [tuple(r) for r in out.collect()] == [(1, None)]
    with pytest.raises(SchemaError):
        schema.evolve(spark.createDataFrame([("1",)], "k string"), new)
    assert [f.name for f in schema.reconcile(T.StructType(new.fields[:1]), new)[0]] == ["n"]


def test_control():
    job = Job("j")
    job.pause()
    t = threading.Thread(target=job.check)
    t.start()
    job.resume()
    t.join(5)
    assert not t.is_alive()
    job.stop()
    with pytest.raises(Stopped):
        job.check()
    assert job.resume()["state"] == "stopped" and job.health()["ok"]


def test_config():
    env = {"CHANGELOOM_SOURCE": "envelope_files", "CHANGELOOM_TARGET": "/t", "CHANGELOOM_TABLES": "a, b", "CHANGELOOM_SINK": "snowflake"}
    c = Config.from_env(env)
    assert c.tables == ["a", "b"] and c.batch == 500_000 and c.interval_ms == 30_000
    with pytest.raises(ConfigError, match="CHANGELOOM_TARGET"):
        Config.from_env({k: v for k, v in env.items() if k != "CHANGELOOM_TARGET"})
    with pytest.raises(ConfigError):
        Config.from_env(env | {"CHANGELOOM_BATCH": "-1"})


def test_a_job_drains_what_came_before_it_was_told(spark, tmp_path):
    t, source = target(spark, tmp_path), f"file://{tmp_path}/log"
    put = lambda k: envelope(spark, (0, None, {"k": k, "v": "a"}, [], k)).coalesce(1).write.mode("append").parquet(source)
    put(1)
    n, seen = Normalizer({"s.t": t}), []
    follow = lambda: run(spark.readStream.schema(ENVELOPE).parquet(source), n, f"file://{tmp_path}/ck", 60)
    thread = threading.Thread(target=lambda: seen.append(follow()))
    thread.start()
    while n.job.batches < 1:
        assert thread.is_alive()
        thread.join(0.2)
    put(2)
    assert n.job.drain()["stage"] == "cdc"
    thread.join(60)
    assert seen == [None] and n.job.state == "stopped" and sorted(r.k for r in t.read().collect()) == [1, 2]
    follow()  # a stopped job takes nothing more
    assert n.job.batches == 2


def test_a_failing_batch_ends_the_run_with_its_error(spark, tmp_path):
    n, source = Normalizer({"s.t": target(spark, tmp_path)}), f"file://{tmp_path}/log"
    envelope(spark, (0, None, {"v": "a"}, [], 1)).write.parquet(source)
    with pytest.raises(Exception, match="without a key"):
        run(spark.readStream.schema(ENVELOPE).parquet(source), n, f"file://{tmp_path}/ck", 0)
    assert n.job.state == "stopped" and n.job.health()["ok"] is False
