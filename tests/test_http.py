"""The control surface over HTTP."""

import json
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from changeloom.streaming.control import Job
from changeloom.streaming.http import Control, serve


@pytest.fixture
def surface():
    job, snapshot, seen = Job("shop"), Job("shop-snapshot"), []
    server = serve(Control(job, snapshot, lambda: seen.append("start"), lambda new: seen.append(new)))

    def call(method, path, body=None):
        data = None if body is None else body.encode()
        try:
            with urlopen(Request(f"http://127.0.0.1:{server.server_address[1]}{path}", data, method=method), timeout=10) as r:
                return r.status, json.loads(r.read())
        except HTTPError as e:
            return e.code, json.loads(e.read())

    yield job, snapshot, seen, call
    server.shutdown()
    server.server_close()


def test_state_and_snapshot(surface):
    job, snapshot, seen, call = surface
    assert call("GET", "/api/v1/health") == (200, {"ok": True, "error": None})
    for word, state in (("pause", "paused"), ("resume", "running"), ("drain", "draining"), ("stop", "stopped"), ("resume", "stopped")):
        code, got = call("POST", f"/api/v1/cdc/{word}")
        assert code == 200 and got["state"] == job.state == state
    assert call("POST", "/api/v1/cdc/snapshot/pause")[1]["state"] == snapshot.state == "paused"
    assert call("GET", "/api/v1/cdc/status")[1]["snapshot"]["state"] == "paused"
    assert call("POST", "/api/v1/cdc/snapshot/resume")[1]["state"] == "running"
    assert call("POST", "/api/v1/cdc/snapshot/start")[0] == 200 and call("POST", "/api/v1/cdc/reload", '{"batch": 5}')[0] == 200
    assert seen == ["start", {"batch": 5}]
    job.fail(ValueError("broken"))
    assert call("GET", "/api/v1/health")[1] == {"ok": False, "error": "broken"}


def test_metrics_and_bad_requests(surface):
    job, _, seen, call = surface
    for k in range(3):
        job.done(k, 10, None, 2.0)
    code, got = call("GET", "/api/v1/cdc/metrics?samples=2")
    assert code == 200 and len(got["samples"]) == 2 and got["records"] == 30 and got["records_per_second"] == 5.0
    assert call("GET", "/api/v1/cdc/metrics?samples=0")[0] == call("GET", "/api/v1/cdc/metrics?samples=x")[0] == 400
    assert call("POST", "/api/v1/cdc/reload", "{")[0] == call("POST", "/api/v1/cdc/reload", "[1]")[0] == 400 and not seen
    assert call("GET", "/api/v1/cdc/pause")[0] == 405 and call("GET", "/api/v1/none")[0] == call("GET", "/health")[0] == 404
    assert Control(Job()).answer("POST", "/api/v1/cdc/snapshot/start")[0] == 400
