"""Rows as they may be shown: the fields of a surface and no others, texts redacted and then bounded, lists sampled with their totals.

Redaction comes before every cut, so a cut shows no part of a secret; bounds are in UTF-8 bytes and split no character.

Defined cases: a null field stays null and is not truncated; a column that a table does not have is null; columns that are not of the surface go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as T

#: Bytes of a title or heading in a map, headings in a sample, bytes of a symbol's text and of a section.
FIELD_BYTES, HEADINGS, SYMBOL_BYTES, SECTION_BYTES = 160, 8, 2000, 4000
DOCUMENT = {"path": "string", "title": "string", "headings": "array<string>", "links": "array<string>", "doc_status": "string", "authority": "string", "currency_state": "string", "canonical_owner": "string", "superseded_by": "string", "last_reviewed": "string", "modified_at": "timestamp"}
SYMBOL = {"node_id": "string", "kind": "string", "name": "string", "qualified_name": "string", "path": "string", "language": "string", "start_line": "int", "start_column": "int", "end_line": "int", "end_column": "int", "signature": "string", "docstring": "string"}


def fields(df: DataFrame, shape: dict[str, str]) -> DataFrame:
    """The columns of a shape, in its order and types."""
    return df.select(*((F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)).alias(c) for c, t in shape.items()))


def bounded(value: Column, most_bytes: int) -> tuple[Column, Column]:
    """(the redacted text of at most so many bytes, whether something was cut)."""
    whole = T.redacted(value)
    return T.utf8_prefix(whole, most_bytes), F.coalesce(F.octet_length(whole) > most_bytes, F.lit(False))


def public_documents(docs: DataFrame, max_headings: int = HEADINGS, field_bytes: int = FIELD_BYTES) -> DataFrame:
    """DOCUMENT with bounded title and headings, their truncation, how many headings and links there are, and without links themselves."""
    own = fields(docs, DOCUMENT)
    title, cut = bounded(F.col("title"), field_bytes)
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    sample = F.transform(F.slice("headings", 1, max_headings), lambda h: bounded(h, field_bytes)[0])
    kept = [c for c in DOCUMENT if c not in ("title", "headings", "links")]
    return own.select(*kept, title.alias("title"), cut.alias("title_truncated"), sample.alias("headings"), count("headings").alias("total_heading_count"), (count("headings") > max_headings).alias("headings_truncated"), count("links").alias("total_link_count"))


def public_symbols(nodes: DataFrame, most_bytes: int = SYMBOL_BYTES) -> DataFrame:
    """SYMBOL with signature and docstring redacted and bounded; identity, path and range as they are."""
    own = fields(nodes, SYMBOL)
    out = {c: bounded(F.col(c), most_bytes) for c in ("signature", "docstring")}
    return own.withColumns({c: v for c, (v, _) in out.items()} | {f"{c}_truncated": cut for c, (_, cut) in out.items()})


def public_sections(sections: DataFrame, most_bytes: int = SECTION_BYTES) -> DataFrame:
    """path, start_line, end_line, text, byte_count (of the whole redacted text), truncated."""
    text, cut = bounded(F.col("text"), most_bytes)
    return sections.select("path", "start_line", "end_line", text.alias("text"), F.octet_length(T.redacted(F.col("text"))).alias("byte_count"), cut.alias("truncated"))
