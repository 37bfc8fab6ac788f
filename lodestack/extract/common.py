"""Builders that all extractors share."""

from __future__ import annotations

import hashlib
import json


def rng(l0: int, c0: int, l1: int, c1: int) -> dict:
    return {"start_line": l0, "start_column": c0, "end_line": l1, "end_column": c1}


class Batch:
    """What one file yields."""

    def __init__(self, path: str, language: str):
        self.path, self.language = path, language
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.refs: list[dict] = []

    def node(self, kind: str, name: str, qualified: str | None, at: dict | None, signature: str | None = None, docstring: str | None = None, **metadata) -> str:
        start = "" if at is None else f"{at['start_line']}:{at['start_column']}"
        ident = hashlib.sha256("|".join((self.path, kind, qualified or name, start)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
        self.nodes.append({"node_id": ident, "kind": kind, "name": name, "qualified_name": qualified, "range": at, "signature": signature, "docstring": docstring, "metadata": json.dumps(metadata, sort_keys=True)})
        return ident

    def edge(self, source: str, target: str | None, kind: str, at: dict | None, provenance: str, confidence: float, **metadata) -> None:
        self.edges.append({"source": source, "target": target, "kind": kind, "range": at, "provenance": provenance, "confidence": confidence, "metadata": json.dumps(metadata, sort_keys=True)})

    def ref(self, source: str, name: str, kind: str, at: dict | None, confidence: float, static: bool = True, receiver: str | None = None, import_dir: str | None = None, paths: list[str] | None = None, **metadata) -> None:
        self.refs.append({"source": source, "name": name, "kind": kind, "range": at, "static": static, "receiver": receiver, "import_dir": import_dir, "paths": paths or [], "confidence": confidence, "metadata": json.dumps(metadata, sort_keys=True)})

    def module(self, text: str) -> str:
        """The node of the file itself."""
        stem = self.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        return self.node("module", stem, self.path.rsplit(".", 1)[0].replace("/", "."), rng(1, 0, text.count("\n") + 1, 0))


def blanked(text: str, line_comment: str | None, block: tuple[str, str] | None, quotes: str) -> str:
    """Text of the same length whose comments and string contents are spaces, so that patterns see code alone."""
    out, i, n = list(text), 0, len(text)

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        if line_comment and text.startswith(line_comment, i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            wipe(i, j)
            i = j
        elif block and text.startswith(block[0], i):
            j = text.find(block[1], i + len(block[0]))
            j = n if j < 0 else j + len(block[1])
            wipe(i, j)
            i = j
        elif text[i] in quotes:
            q, j = text[i], i + 1
            while j < n and text[j] != q and (q == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            wipe(i + 1, j)
            i = j + 1
        else:
            i += 1
    return "".join(out)


class Lines:
    """Offsets to (line from 1, column from 0)."""

    def __init__(self, text: str):
        import bisect

        self.starts = [0]
        at = text.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = text.find("\n", at + 1)
        self._find = bisect.bisect_right

    def at(self, offset: int) -> tuple[int, int]:
        line = self._find(self.starts, offset)
        return line, offset - self.starts[line - 1]

    def span(self, a: int, b: int) -> dict:
        return rng(*self.at(a), *self.at(b))


def closing(code: str, start: int, open_: str = "{", close: str = "}") -> int:
    """Offset after the bracket that closes the first one at or after start; the end of the text when none does."""
    depth, i = 0, code.find(open_, start)
    if i < 0:
        return len(code)
    while i < len(code):
        if code[i] == open_:
            depth += 1
        elif code[i] == close:
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(code)
