"""Files whose name, or a folder above them, begins with a dot or an underscore: Spark's own listing leaves these out.

A Python data source lists them. The driver lists the folders of the first levels; each of these is walked, and its
files are read, by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size_bytes long, mtime_ms long, content binary"
#: Folders of a version control system hold no files of the tree.
PRUNED = [".git", ".hg", ".svn"]


def hidden(path: str) -> bool:
    """Whether Spark's listing leaves out a path below its root."""
    return any(p.startswith((".", "_")) for p in path.split("/"))


@dataclass
class Folder(InputPartition):
    """A folder, with all below it or its own files alone."""

    path: str
    deep: bool


class HiddenFiles(DataSource):
    """Options: path (any that pyarrow's file systems open), pruned (names, comma-separated), max_bytes of a file's content."""

    @classmethod
    def name(cls) -> str:
        return "lodestack_hidden_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HiddenReader(dict(self.options))


class HiddenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.pruned = set(options.get("pruned", ",".join(PRUNED)).split(","))
        self.most = int(options.get("max_bytes", 2_000_000))

    def _open(self):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:") else "file://" + self.root)
        return system, root.rstrip("/")

    def _list(self, system, path: str) -> tuple[list, list[str]]:
        from pyarrow import fs

        entries = sorted(system.get_file_info(fs.FileSelector(path)), key=lambda e: e.path)
        return [e for e in entries if e.type == fs.FileType.File], [e.path for e in entries if e.type == fs.FileType.Directory and e.base_name not in self.pruned]

    def partitions(self) -> list[Folder]:
        system, root = self._open()
        out, level = [Folder(root, False)], self._list(system, root)[1]
        if len(level) < 64:  # one level more, so that a few large folders are dealt out
            out += [Folder(p, False) for p in level]
            level = [q for p in level for q in self._list(system, p)[1]]
        return out + [Folder(p, True) for p in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, root = self._open()
        todo = [partition.path]
        while todo:
            files, folders = self._list(system, todo.pop())
            if partition.deep:
                todo += reversed(folders)
            for e in files:
                path = e.path[len(root) + 1 :]
                if hidden(path):
                    with system.open_input_stream(e.path) as f:
                        content = f.read(self.most + 1) if e.size > self.most else f.read()
                    yield path, e.size, int(e.mtime.timestamp() * 1000) if e.mtime else None, content if e.size <= self.most else None
