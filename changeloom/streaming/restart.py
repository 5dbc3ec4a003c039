"""What a job checks before it goes on from a stored position."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from changeloom.errors import PositionGap
from changeloom.operators import gtid, schema
from changeloom.streaming.store import Target


def check_position(spark: SparkSession, stored: str | None, purged: str) -> bool:
    """Whether there is a stored set of transactions to go on from. If the source has purged any that it lacks, they are lost: an error."""
    if not (stored or "").strip():
        return False
    sets = gtid.parse(spark.createDataFrame([("stored", stored), ("purged", purged or "")], "set_id string, gtid string"))
    pair = spark.createDataFrame([("stored", "purged")], "a string, b string")
    if not gtid.superset(sets, pair).first().is_superset:
        raise PositionGap(f"the source has purged transactions that {stored} lacks")
    return True


def reconcile_target(target: Target, source: T.StructType) -> list[str]:
    """Give a target the columns that its source got meanwhile, published at once; the names that the source dropped, which stay. A column of
    another type is an error, and then nothing is added."""
    known = target.schema
    add, gone = schema.reconcile(known, source)
    if add:
        target.add_columns(add)
        try:
            target._publish()
        except Exception:
            target.schema = known
            raise
    return gone
