"""Watermarks, evictions, chunk plans and position sets."""

import itertools

import pytest

from changeloom.operators import gtid, merge, reconcile, snapshot

CHUNKS = [("r1", 0, 100, 400), ("r1", 100, 200, 600), ("r2", 0, 50, 300)]


def test_watermark_table(spark):
    rows = [(t, pk, pos, op) for t in ("r1", "r2", "r3") for pk in (None, -1, 0, 49, 50, 99, 100, 199, 200) for pos in (300, 301, 400, 401, 600, 601) for op in (0, 1, 2)]
    log = spark.createDataFrame(rows, "src_table string, pk long, pos long, op int")
    got = {tuple(r) for r in reconcile.drop_snapshotted(log, spark.createDataFrame(CHUNKS, "src_table string, start_pk long, end_pk long, hw long"), "pk").collect()}
    held = lambda t, pk, pos, op: op != 2 and pk is not None and any(t == c and a <= pk < z and pos <= hw for c, a, z, hw in CHUNKS)
    assert got == {r for r in rows if not held(*r)}


def test_snapshot_at_any_position_gives_the_same_target(spark):
    log = [(k, f"p{pos}", op, [], pos, 0) for pos, (k, op) in enumerate(itertools.product(range(6), (0, 1, 2, 0)), 1)]
    frame = spark.createDataFrame(log, "k long, v string, op int, unchanged array<string>, pos long, seq long")
    empty = spark.createDataFrame([], "k long, v string")
    want = sorted(merge.merge(empty, frame, ["k"], ["v"]).collect())
    for high in (0, 7, 14, 24):
        state = merge.merge(empty, frame.where(f"pos <= {high}"), ["k"], ["v"])
        snap = state.selectExpr("k", "v", "0 AS op", "cast(array() AS array<string>) AS unchanged", f"{high}L AS pos")
        both = reconcile.snapshot_and_log(snap, frame)
        assert sorted(merge.merge(empty, both, ["k"], ["v"]).collect()) == want


@pytest.mark.parametrize("lo,hi,n,size", [(0, 999, 1000, 100), (5, 5, 1, 10), (1, 7, 500, 10), (-50, 49, 30, 7), (0, 10**12, 5, 10**11)])
def test_chunks_cover_every_key_once(spark, lo, hi, n, size):
    chunks = sorted((r.start_pk, r.end_pk) for r in snapshot.plan(spark.createDataFrame([(lo, hi, n)], "lo long, hi long, n long"), size).collect())
    assert chunks[0][0] == lo and chunks[-1][1] == hi + 1
    assert all(a[1] == b[0] for a, b in zip(chunks, chunks[1:]))


def test_empty_table_has_no_chunks(spark):
    assert snapshot.plan(spark.createDataFrame([(None, None, 0)], "lo long, hi long, n long"), 10).count() == 0


def test_superset_of_wide_sets(spark):
    sets = gtid.parse(spark.createDataFrame([("a", "u:1-100000000"), ("b", "u:1-50:51-100"), ("c", ""), ("d", "v:1")], "set_id string, gtid string"))
    pairs = spark.createDataFrame(list(itertools.product("abcd", repeat=2)), "a string, b string")
    got = {(r.a, r.b) for r in gtid.superset(sets, pairs).where("is_superset").collect()}
    assert got == {(x, x) for x in "abcd"} | {(x, "c") for x in "abcd"} | {("a", "b")}


def test_bad_sets_are_errors(spark):
    for text in ("nocolon", "u:x-2"):
        with pytest.raises(Exception):
            gtid.parse(spark.createDataFrame([("a", text)], "set_id string, gtid string")).collect()


def test_complete_chunks_stay_complete(spark):
    state = spark.createDataFrame([("t", 1, 0, 5, 5, "COMPLETE", None)], snapshot.STATE)
    again = spark.createDataFrame([("t", 1, 0, 5, 0, "PENDING", None), ("t", 2, 5, 9, 0, "PENDING", None)], snapshot.STATE)
    assert {(r.partition_id, r.status) for r in snapshot.set_state(state, again).collect()} == {(1, "COMPLETE"), (2, "PENDING")}
    assert snapshot.add_missing(state, again).count() == 2


def test_range_joins_have_no_nested_loop(spark):
    """Keys meet their chunks by equality of a cell, in each of the three joins; rows are those of the plain range."""
    from changeloom.operators import reconcile, snapshot

    chunks = spark.createDataFrame([("t", k, -50 + 10 * k, -40 + 10 * k, 5, 30, 20) for k in range(10) if k != 4], "src_table string, partition_id long, start_pk long, end_pk long, low long, high long, hw long")
    log = spark.createDataFrame([("t", k % 117 - 60, k % 40, 1) for k in range(400)] + [("t", None, 3, 1), ("u", 1, 3, 1)], "src_table string, k long, pos long, op int")
    where = {c.partition_id: (c.start_pk, c.end_pk) for c in chunks.collect()}
    rows = [(r.src_table, r.k, r.pos) for r in log.collect()]
    inside = lambda r: [p for p, (a, z) in where.items() if r[0] == "t" and r[1] is not None and a <= r[1] < z]
    of = snapshot.chunk_of(log.where("src_table = 't'"), "k", chunks)
    assert sorted((r.k, r.pos, r.partition_id) for r in of.collect()) == sorted((*r[1:], p) for r in rows for p in inside(r))
    left = reconcile.drop_snapshotted(log, chunks, "k")
    assert sorted(map(str, ((r.src_table, r.k, r.pos) for r in left.collect()))) == sorted(map(str, (r for r in rows if not inside(r) or r[2] > 20)))
    gone = reconcile.evictions(log, chunks, "k")
    assert {(r.partition_id, r.k) for r in gone.collect()} == {(p, r[1]) for r in rows for p in inside(r) if 5 < r[2] <= 30}
    for df in (of, left, gone):
        assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_active_chunks(spark):
    import pytest

    from changeloom.errors import SourceError
    from changeloom.operators.active import ActiveChunks

    a = ActiveChunks()
    a.register("t", 1, 0, 10, 100)
    with pytest.raises(SourceError):
        a.register("t", 1, 0, 10, 100)
    a.register("t", 2, 10, 20, 100)
    a.set_high("t", 1, 105)
    with pytest.raises(SourceError):
        a.set_high("t", 2, 99)
    log = spark.createDataFrame([("t", 3, 101), ("t", 4, 106), ("t", 12, 101), ("u", 3, 101)], "src_table string, k long, pos long")
    assert [tuple(r) for r in a.evicted(log, "k").collect()] == [("t", 1, 3)] and set(a.of("t")) == {1, 2}
    a.deregister("t", 1)
    assert a.evicted(log, "k").count() == 0
