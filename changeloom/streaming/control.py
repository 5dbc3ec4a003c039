"""State, control and metrics of a job, and its settings."""

from __future__ import annotations

import os
import threading
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from changeloom.errors import ChangeError, ConfigError

RUNNING, PAUSED, DRAINING, STOPPED = "running", "paused", "draining", "stopped"
INIT, SETUP, SNAPSHOT, CDC = "init", "setup", "snapshot", "cdc"

# Largest batch in records and flush interval in milliseconds by kind of target, and the defaults.
SINK_LIMITS = {"postgres": (250_000, 10_000), "starrocks": (100_000, 5_000), "snowflake": (500_000, 30_000)}
DEFAULT_BATCH, DEFAULT_INTERVAL_MS = 10_000, 5_000


class Stopped(ChangeError):
    """The job was told to stop."""


@dataclass
class Config:
    source: str
    target: str
    tables: list[str]
    job: str = "default"
    batch: int = DEFAULT_BATCH
    interval_ms: int = DEFAULT_INTERVAL_MS
    chunk: int = 50_000
    deletes: str = "soft"
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "CHANGELOOM_") -> Config:
        env = dict(os.environ if env is None else env)
        mine = {k.removeprefix(prefix).lower(): v for k, v in env.items() if k.startswith(prefix)}
        if lacking := [k for k in ("source", "target", "tables") if not mine.get(k)]:
            raise ConfigError("missing " + ", ".join(prefix + k.upper() for k in lacking))
        limits = SINK_LIMITS.get(mine.get("sink", ""), (DEFAULT_BATCH, DEFAULT_INTERVAL_MS))
        try:
            numbers = {k: int(mine.get(k, d)) for k, d in (("batch", limits[0]), ("interval_ms", limits[1]), ("chunk", 50_000))}
        except ValueError as e:
            raise ConfigError(str(e)) from e
        if min(numbers.values()) <= 0:
            raise ConfigError("batch, interval_ms and chunk must be positive")
        known = {"source", "target", "tables", "job", "batch", "interval_ms", "chunk", "deletes"}
        tables = [t.strip() for t in mine["tables"].split(",") if t.strip()]
        return cls(mine["source"], mine["target"], tables, mine.get("job", "default"), numbers["batch"], numbers["interval_ms"], numbers["chunk"], mine.get("deletes", "soft"), {k: v for k, v in mine.items() if k not in known})


class Job:
    """What a control surface needs: health, state, pause, resume, drain, stop, stage, status, metrics. Safe across threads."""

    def __init__(self, name: str = "default"):
        self.name, self.state, self.stage, self.error = name, RUNNING, INIT, None
        self.batches = self.records = self.skipped = 0
        self.last_batch, self.lag_ms, self.samples = -1, None, []
        self._wake = threading.Condition()

    def _set(self, state: str) -> dict:
        with self._wake:
            if self.state != STOPPED:
                self.state = state
            self._wake.notify_all()
        return self.status()

    def pause(self) -> dict:
        return self._set(PAUSED)

    def resume(self) -> dict:
        return self._set(RUNNING)

    def drain(self) -> dict:
        return self._set(DRAINING)

    def stop(self) -> dict:
        return self._set(STOPPED)

    def check(self) -> None:
        """Before a batch: wait while paused, raise when stopped."""
        with self._wake:
            while self.state == PAUSED:
                self._wake.wait()
            if self.state == STOPPED:
                raise Stopped(self.name)

    def wait(self, seconds: float) -> None:
        """Between batches: wait so long, less if the job is told something."""
        with self._wake:
            if self.state == RUNNING:
                self._wake.wait(seconds)

    def done(self, batch: int, records: int, commit: datetime | None, seconds: float) -> None:
        self.batches, self.records, self.last_batch = self.batches + 1, self.records + records, batch
        if commit is not None:
            self.lag_ms = max(0, int((datetime.now(timezone.utc) - commit.replace(tzinfo=commit.tzinfo or timezone.utc)).total_seconds() * 1000))
        self.samples = [*self.samples[-59:], {"time": time.time(), "records": records, "seconds": seconds, "lag_ms": self.lag_ms}]

    def fail(self, e: Exception) -> None:
        self.error = str(e)
        self._set(STOPPED)

    def health(self) -> dict:
        return {"ok": self.error is None, "error": self.error}

    def status(self) -> dict:
        return {"job": self.name, "state": self.state, "stage": self.stage, "batches": self.batches, "records": self.records, "last_batch": self.last_batch, "lag_ms": self.lag_ms, "skipped": self.skipped, "error": self.error}

    def metrics(self) -> dict:
        seconds = sum(s["seconds"] for s in self.samples)
        return self.status() | {"records_per_second": sum(s["records"] for s in self.samples) / seconds if seconds else 0.0, "samples": list(self.samples)}
