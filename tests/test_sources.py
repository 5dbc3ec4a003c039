"""Bytes and events to envelope rows."""

import json

import pytest

from changeloom.errors import ConfigError, DecodeError, SourceError
from changeloom.sources import binlog, pgoutput, registry

COLUMNS = [("id", 23, 1), ("name", 25, 0), ("tags", 1007, 0), ("ok", 16, 0)]


def frames():
    f = pgoutput.frame
    return [
        f(pgoutput.begin(50, 1000, 7), 10),
        f(pgoutput.relation(1, "public", "t", COLUMNS), 11),
        f(pgoutput.insert(1, ["1", "ü", "{1,NULL}", "t"]), 12),
        f(pgoutput.update(1, ["1", pgoutput.UNSENT, None, "f"], ["0", "ü", None, None]), 13),
        f(pgoutput.delete(1, ["1", None, None, None]), 14),
        f(pgoutput.commit(60, 1000), 15),
    ]


def test_envelope_of_frames():
    rows = list(pgoutput.envelope(frames()))
    assert [r["op"] for r in rows] == [11, 10, 0, 1, 2, 12]
    assert json.loads(rows[2]["after"]) == {"id": 1, "name": "ü", "tags": [1, None], "ok": True}
    assert rows[3]["unchanged"] == ["name"] and "name" not in json.loads(rows[3]["after"]) and json.loads(rows[3]["before"])["id"] == 0
    assert rows[4]["after"] is None and rows[2]["xid"] == 7 and rows[2]["pos"] == 12


def test_unknown_is_dropped_and_broken_is_an_error():
    assert list(pgoutput.envelope([pgoutput.frame(b"Y123", 1)])) == []
    assert list(pgoutput.envelope([pgoutput.frame(pgoutput.insert(9, ["1"]), 1)])) == []
    for cut in (30, 33, 36):
        with pytest.raises(DecodeError):
            list(pgoutput.envelope([frames()[2][:cut]]))
    with pytest.raises(DecodeError):
        list(pgoutput.envelope([b"w123"]))
    assert len(pgoutput.status_reply(1, 2, 3, 4)) == 34


def test_more_than_64_unsent_columns():
    cols = [(f"c{k}", 25, 0) for k in range(80)]
    rows = list(pgoutput.envelope([pgoutput.frame(pgoutput.relation(1, "s", "t", cols), 1), pgoutput.frame(pgoutput.update(1, [pgoutput.UNSENT] * 80), 2)]))
    assert len(rows[1]["unchanged"]) == 80


def test_frames_as_a_stream(spark, tmp_path):
    (tmp_path / "a.hex").write_text("\n".join(f.hex() for f in frames()) + "\n")
    spark.dataSource.register(registry.RecordedFrames)
    seen = []
    q = spark.readStream.format("changeloom_frames").option("path", str(tmp_path / "*.hex")).option("batch", "4").load().writeStream.foreachBatch(lambda df, k: seen.append([bytes(r.data) for r in df.orderBy("n").collect()])).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [f for part in seen for f in part] == frames()


def test_transactions_of_events():
    table = {"type": "table_map", "id": 1, "schema": "s", "table": "t", "columns": ["id", "at", "n"], "types": ["INT", "TIMESTAMP", "BIGINT"]}
    events = [{"type": "gtid", "sid": bytes(16), "number": 5}, {"type": "query", "text": "BEGIN"}, table, {"type": "write", "id": 1, "rows": [[1, 1778368097, 2**63 + 1]]}, {"type": "xid"}]
    rows = list(binlog.envelope(events))
    assert [r["op"] for r in rows] == [11, 0, 12] and json.loads(rows[1]["after"]) == {"id": 1, "at": "2026-05-09 23:08:17", "n": 2**63 + 1}
    assert rows[1]["pos_gtid"].endswith(":5")
    assert list(binlog.envelope([*events[:4], {"type": "query", "text": " rollback;"}])) == []
    assert list(binlog.envelope(events, {"s.other"}))[0]["op"] == 11
    with pytest.raises(DecodeError):
        list(binlog.envelope([{"type": "write", "id": 3, "rows": []}]))


def test_server_checks_and_resume():
    good = {"version": "8.0", "gtid_mode": "on", "binlog_format": "ROW", "binlog_row_image": "full", "grants": ["Replication Slave"]}
    assert binlog.check_server(good) == []
    with pytest.raises(SourceError, match="gtid_mode"):
        binlog.check_server(good | {"gtid_mode": "off"})
    assert binlog.resume_point({"pos_kind": "binlog", "pos_gtid": "u:1"}) == "u:1" and binlog.resume_point({"pos_kind": "lsn", "pos_gtid": "u:1"}) is None


def test_registry():
    with pytest.raises(ConfigError):
        registry.create("nothing")
    with pytest.raises(ConfigError):
        registry.create("envelope_files").validate()
    assert registry.without_parameter("postgres://h/db?replication=database&x=1") == "postgres://h/db?x=1"
