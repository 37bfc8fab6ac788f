"""The extraction table function: files in, one row with nodes, edges and references out; and its tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.extract import languages, resources
from lodestack.extract.common import Batch
from lodestack.shipping import ship

EXTRACTORS: dict[str, Callable[[str, str], Batch]] = {
    "python": languages.python, "javascript": languages.javascript, "typescript": languages.typescript, "go": languages.go, "cpp": languages.cpp, "c": languages.c, "ruby": languages.ruby,
}
CAPABILITY = {"python": "semantic", "ruby": "partial_semantic", "javascript": "partial_semantic", "typescript": "partial_semantic", "go": "partial_semantic", "cpp": "partial_semantic", "c": "partial_semantic"}


def extract_one(path: str, language: str, text: str) -> Batch:
    """A language's own extractor, else a resource extractor by name and content."""
    if language in EXTRACTORS:
        return EXTRACTORS[language](path, text)
    name = path.rsplit("/", 1)[-1].lower()
    if language in ("yaml", "json") and resources.is_template(text):
        return resources.cloudformation(path, text)
    if path.rsplit("/", 1)[-1] == "CMakeLists.txt":
        return resources.cmake(path, text)
    if name.endswith((".sln", ".csproj", ".fsproj", ".vbproj")):
        return resources.dotnet(path, text)
    return resources.generic(path, text, language)


def extract(files: DataFrame) -> DataFrame:
    """files: path, language, text. A text that an extractor refuses gives its error and no rows; null texts are skipped."""
    ship(files.sparkSession)
    probe = files.sparkSession.range(0).select(F.from_json(F.lit("{}"), f"struct<{_inline(schemas.EXTRACTED)}>").alias("r")).select("r.*")
    schema = probe.schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "text"))):
                try:
                    got = extract_one(path, language, text)
                    rows.append({"path": path, "language": language, "nodes": got.nodes, "edges": got.edges, "refs": got.refs, "error": None})
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"path": path, "language": language, "nodes": [], "edges": [], "refs": [], "error": type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.where("text IS NOT NULL").select("path", "language", "text").mapInArrow(run, schema)


def _inline(ddl: str) -> str:
    """Top-level DDL columns as struct fields."""
    out, depth, word = [], 0, ""
    for ch in ddl:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and not depth:
            out.append(word)
            word = ""
        else:
            word += ch
    return ", ".join(f"{n}: {t}" for n, t in (w.strip().split(" ", 1) for w in [*out, word]))


def tables(extracted: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, refs (with ref_id) and errors of extracted rows."""
    flat = lambda c: extracted.select("path", "language", F.explode(c).alias("x")).select("path", "language", "x.*")
    refs = flat("refs")
    ident = F.sha2(F.concat_ws("|", "source", "name", "kind", F.to_json("range")), 256)
    return {"nodes": flat("nodes"), "edges": flat("edges"), "refs": refs.withColumn("ref_id", ident).dropDuplicates(["ref_id"]), "errors": extracted.where("error IS NOT NULL").select("path", "error")}
