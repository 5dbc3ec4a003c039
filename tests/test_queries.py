"""Every query with SQL against that SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from changeloom.plans import changelog, probes, staged, streamed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, str):
        return v
    return str(int(v)) if hasattr(v, "__int__") and int(v) == v else str(v)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, oracle, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    rel = oracle.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    want = sorted(tuple(plain(dict(zip(cols, r))[c]) for c in names) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["staged_drain", "stream_normalize", "merge_two_batches"])
def test_large_keys_reach_later_batches(spark, tmp_path, name):
    """Keys of over 10,000,000 put their records into batches after the fourth."""
    orders = spark.read.parquet(f"{SF}/orders.parquet").where("o_orderkey < 400")
    path = str(tmp_path / "orders.parquet")
    orders.withColumn("o_orderkey", (F.col("o_orderkey") + 11_000_000).cast(orders.schema["o_orderkey"].dataType)).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}/*.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(plain(v) for v in r) for r in rel.fetchall())
    got = entry.queries()[name](spark, str(tmp_path)).select(*cols)
    assert sorted(tuple(plain(v) for v in r) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["stream_normalize", "staged_drain", "json_sink", "merge_soft_split", "staged_drain_retry", "snapshot_again", "snapshot_run"])
def test_a_log_is_made_once(spark, monkeypatch, name):
    """However many batches a log has: each takes its own rows, not all of them."""
    log, made = changelog.orders_log(spark, SF), spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            made.add(len(p))
            yield p

    for plans in (streamed, staged, probes):
        monkeypatch.setattr(plans, "orders_log", lambda spark, sf_dir: log.mapInPandas(counted, log.schema))
    entry.queries()[name](spark, SF).collect()
    assert made.value == log.count()


def test_a_recorded_batch_is_read_without_the_others(spark, tmp_path):
    log = changelog.orders_log(spark, SF)
    kept = changelog.recorded(log, str(tmp_path / "log"))
    assert kept.columns == log.columns and sorted(map(str, kept.collect())) == sorted(map(str, log.collect()))
    for k in (ids := changelog.batch_ids(kept))[1:]:
        (tmp_path / f"log/batch_id={k}").rename(tmp_path / f"{k}")
    assert kept.where(F.col("batch_id") == ids[0]).count() == log.where(F.col("batch_id") == ids[0]).count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
