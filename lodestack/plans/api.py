"""Requests, envelopes and signed cursors of the public query surface."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from lodestack.plans.planning import trust

#: Default and largest value of each limit.
LIMITS = {
    "symbol_search": {"results": (20, 100), "source_bytes": (0, 2000)}, "find_references": {"depth": (1, 5), "results": (50, 100)}, "impact": {"depth": (2, 5), "nodes": (50, 200)}, "docs_search": {"results": (10, 50)},
    "docs_current_for_task": {"docs": (10, 50)}, "docs_map": {"docs": (50, 200), "headings": (20, 50)}, "docs_read_section": {"bytes": (4000, 12000)}, "check_markdown_document": {"findings": (50, 200)},
    "check_markdown_set": {"findings": (100, 500), "docs": (20, 100)}, "changed_files_context": {"files": (20, 50), "commands": (10, 20)},
}


class BadRequest(ValueError):
    pass


def limits(surface: str, **asked: int) -> dict[str, int]:
    """Limits with defaults; unknown names and values out of range are refused."""
    known = LIMITS[surface]
    if unknown := set(asked) - set(known):
        raise BadRequest(f"unknown: {sorted(unknown)}")
    out = {}
    for name, (default, most) in known.items():
        v = asked.get(name, default)
        if isinstance(v, bool) or not isinstance(v, int) or not (0 if default == 0 else 1) <= v <= most:
            raise BadRequest(f"{name} must be from 1 to {most}")
        out[name] = v
    return out


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _un64(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def offset_cursor(kind: str, offset: int) -> str:
    """An unsigned cursor of an offset page, typed by the kind of page."""
    return _b64(json.dumps({"kind": kind, "offset": offset}, sort_keys=True, separators=(",", ":")).encode())


def read_offset(cursor: str | None, kind: str, strict: bool = False) -> int:
    """Offset of a cursor. One that is malformed or of another kind begins anew at 0; strict refuses it (the documentation map does)."""
    if cursor is None:
        return 0
    try:
        data = json.loads(_un64(cursor))
        if isinstance(data, dict) and data.get("kind") == kind and type(data.get("offset")) is int and data["offset"] >= 0:
            return data["offset"]
    except ValueError:
        pass
    if strict:
        raise BadRequest("cursor")
    return 0


@dataclass
class Cursors:
    """Signed cursors: base64url JSON bound to an identity (snapshot, query, scope, policy) and a key epoch."""

    key: bytes
    epoch: int = 1

    def _sign(self, body: str) -> str:
        return _b64(hmac.new(self.key, f"{self.epoch}.{body}".encode(), hashlib.sha256).digest())

    def make(self, identity: dict, position: int, frozen: str | None = None) -> str:
        """frozen: the stored result that the cursor goes on in."""
        data = {"epoch": self.epoch, "identity": identity, "position": position} | ({"frozen": frozen} if frozen else {})
        body = _b64(json.dumps(data, sort_keys=True, separators=(",", ":")).encode())
        return f"{body}.{self._sign(body)}"

    def frozen(self, cursor: str, identity: dict) -> str | None:
        self.read(cursor, identity)
        return json.loads(_un64(cursor.partition(".")[0])).get("frozen")

    def read(self, cursor: str, identity: dict) -> int:
        """Position; a cursor that is forged, of another key or of another identity is refused."""
        body, _, sig = cursor.partition(".")
        if not hmac.compare_digest(sig, self._sign(body)):
            raise BadRequest("cursor signature")
        data = json.loads(_un64(body))
        if data["epoch"] != self.epoch or data["identity"] != identity:
            raise BadRequest("cursor identity")
        return int(data["position"])


@dataclass
class Envelope:
    """Rows with what is known about them: freshness, validity, capability, evidence, truncation, trust, warnings, errors."""

    data: list[dict]
    surface: str
    freshness: str = "fresh"
    validity: str = "valid"
    capability: str = "unsupported"
    evidence: list[str] = field(default_factory=list)
    status: str = "not_applicable"
    truncated: bool = False
    next_cursor: str | None = None
    warnings: list[str] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        meta = {k: v for k, v in asdict(self).items() if k not in ("data", "warnings", "errors")}
        meta["trust"] = trust(self.surface, self.evidence, self.capability, self.freshness, self.validity, self.status, bool(self.warnings or self.errors))
        return {"data": self.data, "meta": meta, "warnings": self.warnings, "errors": self.errors}


def page(rows: DataFrame, n: int, surface: str, cursors: Cursors | None = None, identity: dict | None = None, start: int = 0, **meta) -> Envelope:
    """The first n rows of a small ordered page of n + 1: the one more tells that there is more."""
    got = [r.asDict(recursive=True) for r in rows.limit(n + 1).collect()]
    more = len(got) > n
    cursor = cursors.make(identity or {}, start + n) if more and cursors else None
    return Envelope(got[:n], surface, truncated=more, next_cursor=cursor, **meta)
