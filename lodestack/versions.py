"""Numbered states of a folder: what is current is the last state that was written whole, and each number is given out once.

A state is a small JSON file that is created only where none is, so of two writers one gets the number; one that was lost while it
was written has no last line and is passed over. Create-if-absent holds on HDFS and local folders; a store without it needs a
single writer.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from lodestack.shared import filesystem

_END = "\n."


class Conflict(Exception):
    """Another writer has taken the number."""


def read_text(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(b & 0xFF for b in stream.readAllBytes()).decode()
    finally:
        stream.close()


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def numbers(self) -> list[int]:
        fs, root = filesystem(self.spark, self.folder)
        if not fs.exists(root):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(root))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())

    def latest(self) -> tuple[int, dict | None]:
        """(number of the last file, the last whole state): the numbers differ where a writer was lost; (0, None) where there is none."""
        numbers = self.numbers()
        for n in reversed(numbers):
            fs, p = filesystem(self.spark, f"{self.folder}/{n:012d}.json")
            text = read_text(fs, p)
            if text.endswith(_END):
                return numbers[-1], json.loads(text.removesuffix(_END))
        return (numbers[-1] if numbers else 0), None

    def publish(self, number: int, state: dict) -> None:
        fs, p = filesystem(self.spark, f"{self.folder}/{number:012d}.json")
        try:
            stream = fs.create(p, False)
        except Exception as e:
            if fs.exists(p):
                raise Conflict(number) from e
            raise
        try:
            stream.write(bytearray((json.dumps(state) + _END).encode()))
        finally:
            stream.close()

    def prune(self, keep: int) -> None:
        """Deletes all files but the last `keep`."""
        for n in self.numbers()[:-keep]:
            fs, p = filesystem(self.spark, f"{self.folder}/{n:012d}.json")
            fs.delete(p, False)
