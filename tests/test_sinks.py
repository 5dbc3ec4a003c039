"""Sinks: registry, staging, replay."""

import pytest
from pyspark.sql import functions as F

from changeloom.errors import ConfigError, SinkError
from changeloom.streaming import sinks

LOG = "src_schema string, src_table string, op int, before string, after string, unchanged array<string>, pos decimal(20,0), seq long, commit_ts timestamp"


def log(spark):
    from decimal import Decimal

    rows = [("s", "t", 0, None, '{"k":1}', [], Decimal(2**63 + 5), 0, None), ("s", "_own", 0, None, '{"k":2}', [], Decimal(3), 1, None), ("s", "t", 2, '{"k":1}', None, [], Decimal(4), 2, None), ("s", "t", 12, None, None, [], Decimal(9), 3, None)]
    return spark.createDataFrame(rows, LOG)


def test_registry():
    assert set(sinks.SINKS) == {"raw_parquet", "json_files", "merged", "recording"}
    with pytest.raises(ConfigError):
        sinks.create("nothing")
    with pytest.raises(SinkError):
        sinks.create("merged", {}).validate()


def test_raw_parquet_replay_pending_drop(spark, tmp_path):
    sink = sinks.create("raw_parquet", spark, f"file://{tmp_path}/raw")
    for batch in (0, 3, 3):
        told = sink.write(log(spark), batch)
    assert told.records == 3 and told.last_position == 2**63 + 5
    assert sink.pending(-1) == [0, 3] and sink.read().where("_batch_id = 3").count() == 3
    sink.drop(0)
    assert sink.pending(-1) == [3]


def test_json_files(spark, tmp_path):
    sink = sinks.create("json_files", spark, f"file://{tmp_path}/json")
    sink.write(log(spark), 1)
    sink.write(log(spark), 1)
    got = spark.read.json(f"file://{tmp_path}/json").where(F.col("table") == "s.t")
    assert sorted((r.k, r._op_type, r._is_deleted) for r in got.collect()) == [(1, 0, False), (1, 2, True)]
    assert spark.read.json(f"file://{tmp_path}/json").where("table = '_own'").count() == 0


def test_recording(spark):
    sink = sinks.create("recording")
    sink.write(log(spark), 7)
    sink.close()
    assert len(sink.batches[7]) == 4 and sink.closed
