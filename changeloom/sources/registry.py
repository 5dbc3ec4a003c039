"""Sources by name, and a replayable streaming source over recorded envelope files.

Connections to live servers need drivers and a network, which this engine doesn't ship; a class with the methods of `Source`
can be registered for them. Recorded logs are read by the classes below.
"""

from __future__ import annotations

import glob
import json
from abc import ABC, abstractmethod
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from changeloom.errors import ConfigError
from changeloom.model import ENVELOPE


class Source(ABC):
    """A source of envelope rows. Offsets are confirmed only after a target has published what they cover."""

    name = ""

    def __init__(self, **options: str):
        self.options = options

    def validate(self) -> None:
        """Raise if the source can't be used."""

    def setup(self) -> None:
        """Prepare the source."""

    @abstractmethod
    def stream(self, spark: SparkSession) -> DataFrame:
        """A streaming frame of envelope rows."""

    def close(self) -> None:
        """Release what setup made."""


SOURCES: dict[str, type[Source]] = {}


def register(kind: type[Source]) -> type[Source]:
    SOURCES[kind.name] = kind
    return kind


def create(name: str, **options: str) -> Source:
    if name not in SOURCES:
        raise ConfigError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](**options)


@register
class EnvelopeFiles(Source):
    """Parquet files of envelope rows, read as they arrive."""

    name = "envelope_files"

    def validate(self) -> None:
        if "path" not in self.options:
            raise ConfigError("envelope_files needs a path")

    def stream(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream.schema(self.options.get("schema", ENVELOPE))
        return reader.option("maxFilesPerTrigger", self.options.get("maxFilesPerTrigger", "1")).parquet(self.options["path"])


class FrameReader(SimpleDataSourceStreamReader):
    """Recorded frames, one hexadecimal line each, read `batch` at a time. The offset is the number of lines read."""

    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch

    def initialOffset(self) -> dict:
        return {"n": 0}

    def _lines(self, start: int, end: int | None) -> list[tuple[int, bytes]]:
        out, n = [], 0
        for name in sorted(glob.glob(self.path)):
            with open(name, encoding="ascii") as f:
                for line in f:
                    if n >= start and (end is None or n < end):
                        out.append((n, bytes.fromhex(line.strip())))
                    n += 1
                    if end is not None and n >= end or end is None and len(out) >= self.batch:
                        return out
        return out

    def read(self, start: dict) -> tuple:
        rows = self._lines(start["n"], None)
        return iter(rows), {"n": start["n"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._lines(start["n"], end["n"]))

    def commit(self, end: dict) -> None:
        """A live source would confirm its position here."""


class RecordedFrames(DataSource):
    """spark.readStream.format("changeloom_frames"): n, data of recorded frames."""

    @classmethod
    def name(cls) -> str:
        return "changeloom_frames"

    def schema(self) -> str:
        return "n long, data binary"

    def simpleStreamReader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"], int(self.options.get("batch", "1000")))


def without_parameter(url: str, name: str = "replication") -> str:
    """The address without one of its query parameters."""
    parts = urlsplit(url)
    return urlunsplit(parts._replace(query=urlencode([(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k != name])))


def position_json(position: dict) -> str:
    return json.dumps(position, sort_keys=True)
