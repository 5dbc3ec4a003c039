"""Checks before a job goes on, and snapshots that start over."""

import pytest
from pyspark.sql import types as T

from changeloom.errors import PositionGap, SchemaError
from changeloom.operators import snapshot
from changeloom.streaming import restart
from changeloom.streaming.snapshot_run import SnapshotRun
from changeloom.streaming.store import Target

KIND = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def test_purged_transactions_are_a_gap(spark):
    assert restart.check_position(spark, "u:1-10", "u:1-3:5")
    assert restart.check_position(spark, "u:1-10", "")
    assert not restart.check_position(spark, None, "u:1-3")
    with pytest.raises(PositionGap):
        restart.check_position(spark, "u:1-10", "u:1-11")
    with pytest.raises(PositionGap):
        restart.check_position(spark, "u:1-10", "v:1")


def test_reconcile_target(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"), KIND, ["k"])
    with pytest.raises(SchemaError):
        restart.reconcile_target(target, T._parse_datatype_string("k long, v int, w int"))
    assert target.schema == KIND
    assert restart.reconcile_target(target, T._parse_datatype_string("k long, w int")) == ["v"]
    assert Target(spark, str(tmp_path / "t"), KIND, ["k"]).read().columns[:3] == ["k", "v", "w"]


def test_a_forgotten_snapshot_is_taken_again(spark, tmp_path):
    target = Target(spark, str(tmp_path / "t"), KIND, ["k"])
    path = str(tmp_path / "s")
    for place, v in enumerate("abc"):
        run = SnapshotRun(spark, path, "t", target, "k", wave=2)
        if place:
            assert run.state().where(f"status <> '{snapshot.COMPLETE}'").count() == 0
            run.forget()
            assert len(run.files.folders()) == 0
        rows = spark.createDataFrame([(k, v) for k in range(9)], KIND)
        run.prepare(snapshot.key_range(rows, "k"), 3)
        assert run.run(lambda start, end, rows=rows: rows, lambda place=place: place + 1) == 2
        assert SnapshotRun(spark, path, "t", target, "k").run(None, None) == 0
        assert {r.v for r in target.read().collect()} == {v}


def test_a_waves_rows_are_not_dealt_out_by_chunk(spark, tmp_path):
    """A wave has few chunks: rows or changes dealt out by them would meet in as few tasks, however large the table. That mustn't hang on a setting."""
    plans, setting = [], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")

    class Told(Target):
        def apply(self, log, batch, feed="log"):
            plans.append(log._jdf.queryExecution().executedPlan().toString())
            return super().apply(log, batch, feed)

    rows = spark.range(60).selectExpr("id AS k", "'s' AS v")
    log = spark.range(60).selectExpr("id AS k", "1 AS op", "CAST(5 AS decimal(20,0)) AS pos").where("k % 20 = 7")
    marks = iter(range(0, 90, 10))
    target = Told(spark, str(tmp_path / "t"), KIND, ["k"])
    run = SnapshotRun(spark, str(tmp_path / "s"), "t", target, "k", wave=2)
    run.prepare(snapshot.key_range(rows, "k"), 15)
    try:
        assert run.run(lambda start, end: rows, lambda: next(marks), lambda low, high: log) == 2
    finally:
        spark.conf.set(setting, before)
    assert sorted(r.k for r in target.read().collect()) == [k for k in range(60) if k % 20 != 7 or k > 30]
    assert plans and not any("hashpartitioning" in line and "_cell" in line for p in plans for line in p.splitlines())
    assert all("BroadcastHashJoin" in p for p in plans)
