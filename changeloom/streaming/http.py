"""A job's control methods over HTTP, in JSON. Meant for the driver's own host: it binds to the loopback address unless told otherwise, and has no login."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread
from urllib.parse import parse_qs, urlsplit

from changeloom.streaming.control import Job

ROOT = "/api/v1"


class BadRequest(ValueError):
    """A request that can't be answered as it is."""


class Control:
    """Routes to the methods of a job and of its snapshot. start: starts a snapshot; reload: takes new settings, both optional."""

    def __init__(self, job: Job, snapshot: Job | None = None, start: Callable[[], None] | None = None, reload: Callable[[dict], None] | None = None):
        self.job, self.snapshot, self.start, self.reload = job, snapshot, start, reload
        self.routes: dict[tuple[str, str], Callable[[dict, dict], object]] = {
            ("GET", "/health"): lambda query, body: job.health(),
            ("GET", "/cdc/status"): lambda query, body: job.status() | ({"snapshot": snapshot.status()} if snapshot else {}),
            ("GET", "/cdc/metrics"): self._metrics,
            ("POST", "/cdc/pause"): lambda query, body: job.pause(),
            ("POST", "/cdc/resume"): lambda query, body: job.resume(),
            ("POST", "/cdc/drain"): lambda query, body: job.drain(),
            ("POST", "/cdc/stop"): lambda query, body: job.stop(),
            ("POST", "/cdc/reload"): self._reload,
            ("POST", "/cdc/snapshot/start"): self._start,
            ("POST", "/cdc/snapshot/pause"): lambda query, body: self._snapshot().pause(),
            ("POST", "/cdc/snapshot/resume"): lambda query, body: self._snapshot().resume(),
        }

    def _snapshot(self) -> Job:
        if self.snapshot is None:
            raise BadRequest("no snapshot")
        return self.snapshot

    def _start(self, query: dict, body: dict) -> dict:
        if self.start is None:
            raise BadRequest("no snapshot can be started")
        self.start()
        return self.job.status()

    def _reload(self, query: dict, body: dict) -> dict:
        if self.reload is None:
            raise BadRequest("settings can't be changed")
        self.reload(body)
        return self.job.status()

    def _metrics(self, query: dict, body: dict) -> dict:
        """The job's metrics; samples=n: the last n samples only."""
        out = self.job.metrics()
        if "samples" in query:
            try:
                n = int(query["samples"][-1])
            except ValueError as e:
                raise BadRequest(str(e)) from e
            if n <= 0:
                raise BadRequest("samples must be positive")
            out["samples"] = out["samples"][-n:]
        return out

    def answer(self, method: str, target: str, content: bytes = b"") -> tuple[int, object]:
        """Status and JSON value for a request."""
        url = urlsplit(target)
        path = url.path.removeprefix(ROOT) if url.path.startswith(ROOT) else None
        route = self.routes.get((method, path))
        if route is None:
            known = any(p == path for _, p in self.routes)
            return (405, {"error": "method"}) if known else (404, {"error": "no such path"})
        try:
            body = json.loads(content) if content.strip() else {}
            if not isinstance(body, dict):
                raise BadRequest("the body must be an object")
            return 200, route(parse_qs(url.query), body)
        except ValueError as e:  # malformed JSON and BadRequest, and what reload doesn't accept
            return 400, {"error": str(e)}
        except Exception as e:
            return 500, {"error": str(e)}


def serve(control: Control, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server in a thread of its own; port 0: any free one (server_address tells). shutdown() ends it."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            code, value = control.answer(self.command, self.path, self.rfile.read(size))
            said = json.dumps(value).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        do_GET = do_POST = _do

        def log_message(self, *args) -> None:
            """Requests are not logged."""

    server = ThreadingHTTPServer((host, port), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server
