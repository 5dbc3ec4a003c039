"""Backfill: copying a table in chunks at known positions while its log goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.errors import SchemaError
from changeloom.functions.types import is_integer_key
from changeloom.model import INSERT
from changeloom.operators import snapshot
from changeloom.streaming.store import Target


def chunks_of(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The chunk plan of a table. A key that isn't an integer gives no ranges: it raises, and the table is copied as one chunk."""
    if not is_integer_key(rows.schema[key].dataType):
        raise SchemaError(f"{key} isn't an integer")
    return snapshot.plan(snapshot.key_range(rows, key), size)


def copy(rows: DataFrame, target: Target, high: int, batch: int, feed: str = "backfill") -> bool:
    """Publish the table's rows as of position `high` as one batch. The log's rows at or below it lose to these, later ones win, whichever came first."""
    log = rows.withColumns({"op": F.lit(INSERT), "pos": F.lit(high).cast("decimal(20,0)"), "seq": F.lit(-1).cast("long")})
    return target.apply(log, batch, feed)
