"""The chunks that are being read, and which of their keys the log changes meanwhile."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeloom.errors import SourceError
from changeloom.operators import reconcile


@dataclass
class Window:
    start: int
    end: int
    low: int
    high: int | None = None


class ActiveChunks:
    """Windows by table and chunk: a bounded number, those of one wave. Evicted keys stay a DataFrame."""

    def __init__(self):
        self.windows: dict[tuple[str, int], Window] = {}

    def register(self, table: str, chunk: int, start: int, end: int, low: int) -> None:
        if (table, chunk) in self.windows:
            raise SourceError(f"chunk {chunk} of {table} is being read already")
        self.windows[table, chunk] = Window(start, end, low)

    def set_high(self, table: str, chunk: int, high: int) -> None:
        w = self.windows[table, chunk]
        if high < w.low:
            raise SourceError(f"chunk {chunk} of {table} ends at {high}, before {w.low}")
        w.high = high

    def deregister(self, table: str, chunk: int) -> None:
        self.windows.pop((table, chunk), None)

    def of(self, table: str) -> dict[int, Window]:
        return {c: w for (t, c), w in self.windows.items() if t == table}

    def evicted(self, log: DataFrame, key: str) -> DataFrame:
        """(src_table, partition_id, key) that the log changed inside a window whose high mark is known."""
        kind = "src_table string, partition_id long, start_pk long, end_pk long, low decimal(20,0), high decimal(20,0)"
        from decimal import Decimal

        rows = [(t, c, w.start, w.end, Decimal(w.low), Decimal(w.high)) for (t, c), w in self.windows.items() if w.high is not None]
        return reconcile.evictions(log, F.broadcast(log.sparkSession.createDataFrame(rows, kind)), key)


def in_range(value: Column, start: Column, end: Column) -> Column:
    """Whether a key lies in [start, end], both given as text: by number where all three are numbers, else as text. Null never does."""
    number = lambda x: x.try_cast("decimal(38,0)")
    numbers = number(value).isNotNull() & number(start).isNotNull() & number(end).isNotNull()
    inside = F.when(numbers, number(value).between(number(start), number(end))).otherwise(value.between(start, end))
    return F.coalesce(inside, F.lit(False))


def key_text(value: Column, kind: str) -> Column:
    """A key as text that tells kinds apart: the number 1 and the text 1 differ."""
    # The marks of the kinds.
    mark = {"bigint": "i", "int": "i", "smallint": "i", "string": "s", "boolean": "b", "double": "f", "float": "f", "binary": "x"}[kind]
    return F.concat(F.lit(f"{mark}:"), F.lower(F.hex(value)) if kind == "binary" else value.cast("string"))
