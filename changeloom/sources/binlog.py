"""Row-based binary log events, as decoded dictionaries, to envelope rows.

Events (type and fields): table_map (id, schema, table, columns, types), write / update / delete (id, rows; of update each row is a
pair before, after), gtid (sid, number), query (text), xid, rotate (file), heartbeat. Rows of a table that wasn't mapped are an error.
A transaction's rows are given out at its commit, with its transaction id as position; after a rollback they are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

from changeloom.errors import DecodeError, SourceError
from changeloom.functions.types import from_mysql
from changeloom.model import BEGIN, COMMIT, DELETE, HEARTBEAT, INSERT, SCHEMA_CHANGE, UPDATE


def gtid_text(sid: bytes, number: int) -> str:
    h = sid.hex()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}:{number}"


def query_kind(text: str) -> str:
    """begin, commit, rollback, or ddl, by the first word."""
    word = (text.strip().split(None, 1) or [""])[0].upper().rstrip(";")
    return word.lower() if word in ("BEGIN", "COMMIT", "ROLLBACK") else "ddl"


def value(x, kind: str):
    """A wire value as JSON value of a column type. Unsigned numbers stay whole; bytes that aren't text become hexadecimal."""
    if x is None:
        return None
    data = from_mysql(kind)
    if isinstance(x, (bytes, bytearray)):
        if data == "TimestampTz" and bytes(x).isdigit():
            x = int(x)
        else:
            try:
                x = bytes(x).decode()
            except UnicodeDecodeError:
                return bytes(x).hex()
            if data == "Bytes":
                return x.encode().hex()
    if data == "TimestampTz" and isinstance(x, int):
        return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=x)).strftime("%Y-%m-%d %H:%M:%S")
    if data == "Time" and isinstance(x, tuple):
        neg, days, h, m, s, *us = x
        return f"{'-' if neg else ''}{24 * days + h:02d}:{m:02d}:{s:02d}" + (f".{us[0]:06d}" if us and us[0] else "")
    if data in ("Json", "Jsonb") and isinstance(x, str):
        try:
            return json.loads(x)
        except ValueError:
            return x
    return x


class Converter:
    """Events in stream order to envelope rows."""

    def __init__(self, tracked: set[str] | None = None):
        self.maps: dict[int, dict] = {}
        self.tracked, self.file, self.gtid, self.held, self.seq = tracked, "", None, [], 0

    def _row(self, e: dict, **more) -> dict:
        self.seq += 1
        return {"pos_kind": "binlog", "pos": e.get("pos", 0), "pos_file": self.file, "pos_gtid": self.gtid, "seq": self.seq} | more

    def image(self, table: dict, row: list | None) -> str | None:
        if row is None:
            return None
        return json.dumps({n: value(v, k) for n, k, v in zip(table["columns"], table["types"], row, strict=False)}, ensure_ascii=False, separators=(",", ":"))

    def rows(self, e: dict) -> Iterator[dict]:
        kind = e["type"]
        if kind == "query":
            kind = query_kind(e["text"])
        if kind == "rotate":
            self.file = e["file"]
        elif kind == "heartbeat":
            yield self._row(e, op=HEARTBEAT)
        elif kind == "table_map":
            self.maps[e["id"]] = e
        elif kind == "gtid":
            self.gtid, self.held = gtid_text(e["sid"], e["number"]), []
        elif kind == "begin":
            self.held = [self._row(e, op=BEGIN)]
        elif kind in ("write", "update", "delete"):
            if (t := self.maps.get(e["id"])) is None:
                raise DecodeError(f"rows of table {e['id']}, which wasn't mapped")
            if self.tracked is not None and f"{t['schema']}.{t['table']}" not in self.tracked:
                return
            op = {"write": INSERT, "update": UPDATE, "delete": DELETE}[kind]
            for r in e["rows"]:
                before, after = r if kind == "update" else (None, r) if kind == "write" else (r, None)
                self.held.append(self._row(e, op=op, src_schema=t["schema"], src_table=t["table"], before=self.image(t, before), after=self.image(t, after)))
        elif kind in ("xid", "commit"):
            yield from self.held
            yield self._row(e, op=COMMIT)
            self.held = []
        elif kind == "rollback":
            self.held = []
        elif kind == "ddl" and (self.tracked is None or any(t.split(".")[0] == e.get("schema") for t in self.tracked)):
            yield self._row(e, op=SCHEMA_CHANGE, src_schema=e.get("schema"), after=json.dumps({"ddl": e["text"]}))


def envelope(events: Iterable[dict], tracked: set[str] | None = None) -> Iterator[dict]:
    convert = Converter(tracked)
    for e in events:
        yield from convert.rows(e)


def resume_point(position: dict | None) -> str | None:
    """The transaction-id set to go on from: only that of a binary log position, and only if it isn't blank."""
    text = (position or {}).get("pos_gtid") or ""
    return text if (position or {}).get("pos_kind") == "binlog" and text.strip() else None


def check_server(settings: dict) -> list[str]:
    """What a server lacks for row-based reading; raises if it can't be used at all. Returns remarks."""
    lacks = []
    if int(str(settings.get("version", "0")).split(".")[0]) < 5:
        lacks.append("version 5 or later")
    for name, want in (("gtid_mode", "ON"), ("binlog_format", "ROW"), ("binlog_row_image", "FULL")):
        if str(settings.get(name, "")).upper() != want:
            lacks.append(f"{name} = {want}")
    if not {"REPLICATION SLAVE", "ALL PRIVILEGES"} & {str(g).upper() for g in settings.get("grants", [])}:
        lacks.append("the privilege REPLICATION SLAVE")
    if lacks:
        raise SourceError("the server lacks " + ", ".join(lacks))
    return ["managed cluster: the log must be kept by its own setting"] if settings.get("aurora_version") else []
