"""A keyed target on Parquet with atomic publication.

A batch is collapsed to one row a key that holds positions beside values (merge.state_of) and appended as a part of its own, so what a
batch writes is in proportion to it. Reading combines the parts by key. As every value has its position, the order in which batches
and backfilled chunks arrive doesn't matter. FAN parts of one level become one of the next, so a row is rewritten a
logarithmic number of times. Deleted keys stay as small marks until forget() says that nothing older can arrive.

One small file, CURRENT, is replaced by a rename; it names the parts, the last batch of each feed and the schema, so readers see all of a
batch or nothing. A batch that was published before changes nothing.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changeloom.model import DELETE
from changeloom.operators import merge as ops
from changeloom.operators.schema import evolve


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only for local sessions without that setting."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="changeloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Files:
    """Small files and folders through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write beside it, then rename over it."""
        trial = self._path(f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(trial, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(trial.toUri() if trial.toUri().getScheme() else self.fs.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(trial, self._path(name), options)

    def folders(self) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        return [s.getPath().getName() for s in self.fs.listStatus(self._path("")) if s.isDirectory()]

    def rename(self, name: str, to: str) -> None:
        if not self.fs.rename(self._path(name), self._path(to)):
            raise OSError(f"{name} can't be renamed to {to} in {self.root}")

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


#: So many parts of one level are made into one.
FAN = 4


class Target:
    """A table of keys and values at a path. Soft deletes keep rows with _is_deleted set."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], deletes: str = "hard"):
        self.spark, self.path, self.keys, self.deletes = spark, path, keys, deletes
        self.files = Files(spark, path)
        self.state = json.loads(self.files.read("CURRENT") or "null") or {"batches": {}, "version": 0, "parts": [], "schema": schema.jsonValue(), "pos": None, "low": None}
        self.schema = T.StructType.fromJson(self.state["schema"])
        self.add_columns(schema.fields)

    @property
    def values(self) -> list[str]:
        return [f.name for f in self.schema.fields if f.name not in self.keys]

    def _stored(self) -> T.StructType:
        at = T._parse_datatype_string(ops.AT)
        values = [f for f in self.schema.fields if f.name not in self.keys]
        marks = [T.StructField("_last", T.StructType([T.StructField("at", at), T.StructField("op", T.IntegerType())])), T.StructField("_gone", at), T.StructField("_image", T.StructType([T.StructField(f.name, f.dataType) for f in values]))]
        return T.StructType([*[f for f in self.schema.fields if f.name in self.keys], *marks, *[T.StructField(f.name, T.StructType([T.StructField("at", at), T.StructField("v", f.dataType)])) for f in values]])

    def _rows(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self._stored())
        rows = self.spark.read.schema(self._stored()).parquet(*[f"{self.path}/{p['folder']}" for p in parts])
        # A part holds a key once, so pre-aggregating would sort all rows once more and join next to none.
        return rows if len(parts) == 1 else ops.combine(rows.repartition(*self.keys), self.keys, self.values)

    def read(self) -> DataFrame:
        """The published rows."""
        return ops.visible(self._rows(self.state["parts"]), self.keys, self.values, self.deletes)

    def add_columns(self, fields: list[T.StructField]) -> None:
        """Additive evolution: old rows read null."""
        self.schema = T.StructType([*self.schema.fields, *[T.StructField(f.name, f.dataType, True) for f in fields if f.name not in self.schema.fieldNames()]])

    def _write(self, state: DataFrame) -> str:
        folder = f"v={self.state['version'] + 1:08d}"
        self.files.remove(folder)  # left by an attempt that wasn't published
        state.write.parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, **change) -> None:
        self.state = self.state | {"version": self.state["version"] + 1, "schema": self.schema.jsonValue()} | change
        self.files.replace("CURRENT", json.dumps(self.state))

    def apply(self, log: DataFrame, batch: int, feed: str = "log") -> bool:
        """Merge a batch and publish; False if it was published before or is empty. log: keys, values, op, pos, seq, unchanged. Batches count up in each feed."""
        if batch <= self.state["batches"].get(feed, -1):
            return False
        folder = self._write(ops.state_of(evolve(log, self.schema), self.keys, self.values))
        high = self._rows([{"folder": folder}]).agg(F.max("_last.at.pos").alias("pos"), F.count("*").alias("n")).first()
        if not high.n:
            self.files.remove(folder)
            return False
        pos = max((int(p) for p in (high.pos, self.state["pos"]) if p is not None), default=None)
        self._publish(batches=self.state["batches"] | {feed: batch}, parts=[*self.state["parts"], {"folder": folder, "level": 0}], pos=pos)
        self.compact()
        return True

    def compact(self, every: bool = False) -> None:
        """Make the last FAN parts of one level into one of the next, again and again; every: all parts into one."""
        while (parts := self.state["parts"]) and (every and len(parts) > 1 or len(parts) >= FAN and len({p["level"] for p in parts[-FAN:]}) == 1):
            some = parts if every else parts[-FAN:]
            rows = self._rows(some)
            if len(some) == len(parts) and self.state["low"] is not None:
                rows = rows.where((F.col("_last.op") != DELETE) | (F.col("_last.at.pos") >= self.state["low"]) | F.lit(self.deletes == "soft"))
            folder = self._write(rows)
            self._publish(parts=[*parts[: -len(some)], {"folder": folder, "level": max(p["level"] for p in some) + 1}])
        self.clean()

    def forget(self, low: int) -> None:
        """Nothing below this position will arrive any more: marks of keys deleted before it may go when parts are joined."""
        self._publish(low=max(low, self.state["low"] or 0))

    def clean(self, keep: int = 2) -> None:
        """Delete folders that aren't parts any more, but for the newest ones, which readers may still be on."""
        named = {p["folder"] for p in self.state["parts"]}
        for name in sorted(f for f in self.files.folders() if f.startswith("v=") and f not in named)[:-keep]:
            self.files.remove(name)
