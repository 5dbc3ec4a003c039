"""Merging: any split of a log into batches gives the fold of the whole log."""

import random

import pytest

from changeloom.operators import merge

SCHEMA = "k long, a long, b string, op int, unchanged array<string>, pos long, seq long"


def fold(rows, soft=False):
    """The log applied row by row."""
    out = {}
    for k, a, b, op, unsent, *_ in sorted(rows, key=lambda r: (r[5], r[6])):
        if op == 2:
            if soft and k in out:
                out[k] = (*out[k][:2], True)
            elif soft:
                out[k] = (a, b, True)
            else:
                out.pop(k, None)
            continue
        old = out.get(k, (None, None, False))
        if soft and len(old) == 3 and old[2]:
            old = (None, None, False)
        out[k] = (old[0] if "a" in unsent else a, old[1] if "b" in unsent else b, False)
    return out


def random_log(seed, n=300, keys=25):
    r = random.Random(seed)
    out = []
    for pos in range(n):
        op = r.choices([0, 1, 2], [3, 6, 2])[0]
        unsent = [c for c in "ab" if op == 1 and r.random() < 0.4]
        out.append((r.randrange(keys), None if "a" in unsent else r.choice([None, r.randrange(99)]), None if "b" in unsent else f"v{pos}", op, unsent, pos // 2, pos))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_fold(spark, seed):
    rows = random_log(seed)
    cuts = sorted(random.Random(seed).sample(range(1, len(rows)), 2))
    target = spark.createDataFrame([], "k long, a long, b string")
    for a, z in zip([0, *cuts], [*cuts, len(rows)]):
        target = merge.merge(target, spark.createDataFrame(rows[a:z], SCHEMA), ["k"], ["a", "b"])
        target = spark.createDataFrame(target.collect(), "k long, a long, b string")
    want = {k: v[:2] for k, v in fold(rows).items()}
    assert {r.k: (r.a, r.b) for r in target.collect()} == want
    whole = merge.merge(spark.createDataFrame([], "k long, a long, b string"), spark.createDataFrame(rows, SCHEMA), ["k"], ["a", "b"])
    assert {r.k: (r.a, r.b) for r in whole.collect()} == want


@pytest.mark.parametrize("seed", [3, 4])
def test_soft_split_gives_the_fold(spark, seed):
    """Columns left out after a soft delete are null, however the log is split."""
    rows = random_log(seed)
    cuts = sorted(random.Random(seed).sample(range(1, len(rows)), 4))
    target = spark.createDataFrame([], "k long, a long, b string, _is_deleted boolean")
    parts = []
    for a, z in zip([0, *cuts], [*cuts, len(rows)]):
        log = spark.createDataFrame(rows[a:z], SCHEMA)
        target = spark.createDataFrame(merge.merge(target, log, ["k"], ["a", "b"], deletes="soft").collect(), target.schema)
        parts.append(merge.state_of(log, ["k"], ["a", "b"]))
    live = {k: v[:2] for k, v in fold(rows, soft=True).items() if not v[2]}
    assert {r.k: (r.a, r.b) for r in target.collect() if not r._is_deleted} == live
    random.Random(seed).shuffle(parts)  # states combine in any order, and twice
    states = parts[0]
    for p in parts[1:] + parts[:2]:
        states = states.unionByName(p)
    seen = merge.visible(merge.combine(states, ["k"], ["a", "b"]), ["k"], ["a", "b"], "soft").collect()
    assert {r.k: (r.a, r.b) for r in seen if not r._is_deleted} == live and {r.k for r in seen} == set(fold(rows, soft=True))


def test_replay_changes_nothing(spark):
    log = spark.createDataFrame(random_log(3), SCHEMA)
    once = merge.merge(spark.createDataFrame([], "k long, a long, b string"), log, ["k"], ["a", "b"])
    twice = merge.merge(spark.createDataFrame(once.collect(), once.schema), log, ["k"], ["a", "b"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_soft_delete_keeps_values_and_makes_tombstones(spark):
    target = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "k long, a long, b string")
    log = spark.createDataFrame([(1, None, None, 2, [], 5, 0), (3, 30, "z", 2, [], 6, 0), (2, 21, None, 1, ["b"], 7, 0)], SCHEMA)
    got = {r.k: (r.a, r.b, r._is_deleted) for r in merge.merge(target, log, ["k"], ["a", "b"], deletes="soft").collect()}
    assert got == {1: (10, "x", True), 2: (21, "y", False), 3: (30, "z", True)}


def test_reinsert_after_soft_delete(spark):
    target = spark.createDataFrame([(1, 10, "x", True)], "k long, a long, b string, _is_deleted boolean")
    log = spark.createDataFrame([(1, 11, "n", 0, [], 5, 0)], SCHEMA)
    assert [tuple(r) for r in merge.merge(target, log, ["k"], ["a", "b"], deletes="soft").collect()] == [(1, 11, "n", False)]


def test_key_change_becomes_delete_and_insert(spark):
    log = spark.createDataFrame([(1, 5, "v", 1, 9, 0), (7, 7, "w", 1, 10, 0)], "before_k long, k long, a string, op int, pos long, seq long")
    assert sorted((r.k, r.op, r.pos) for r in merge.split_key_changes(log, ["k"]).collect()) == [(1, 2, 9), (5, 0, 9), (7, 1, 10)]


def test_collapse_is_one_shuffle(spark):
    log = spark.createDataFrame(random_log(4), SCHEMA)
    plan = merge.collapse(log, ["k"], ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
