"""Blocks of Markdown texts as rows: front block, headings, ordered list items, table rows and inline links.

A text is split once; where the front block ends and which lines lie in fenced code is told by running sums within the row, in time
in proportion to its lines. Lines of fenced code and the fences themselves give no blocks, nor do lines of the front block but for
its fields; fences inside the front block are no fences. A heading line gives a heading alone; any other line may give a list
item, a table row and links at once.

Defined cases: null and empty texts have no blocks; a front block that is not closed is none; null document keys are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.arrays import let, scan

_HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
_ITEM = r"^(\s*)(\d+)[.)]\s+\S"
_LINK = r"(?<!!)\[([^\]]*)\]\(([^)]*)\)"
BLOCK = "array<struct<kind:string,column:int,depth:int,text:string,number:decimal(38,0),indent:int,cells:array<string>,target:string,raw:string>>"
KINDS = ["front_field", "heading", "ordered_list_item", "table_row", "link"]


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def front_end(lines: Column) -> Column:
    """The number of the line that closes the front block, 0 where there is none."""
    closes = F.array_position(F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda s: stripped(s) == "---"), F.lit(True))
    return F.when((stripped(F.get(lines, F.lit(0))) == "---") & (closes > 0), closes + 1).otherwise(0).cast("int")


def lines_of(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line, s, front (in the front block), code (in fenced code, or a fence)."""
    base = docs.select(F.col(doc).alias(doc), F.split(text, "\r?\n").alias("_ls")).where("_ls IS NOT NULL").withColumn("_end", front_end(F.col("_ls")))
    fence = F.transform("_ls", lambda s, i: ((i >= F.col("_end")) & s.rlike(r"^\s*(```|~~~)")).cast("int"))
    base = base.withColumn("_fence", fence).withColumn("_open", scan(F.col("_fence"), lambda x, y: x + y))
    rows = base.select(doc, "_end", F.posexplode(F.arrays_zip("_ls", "_fence", "_open")).alias("n", "x"))
    front = F.col("n") < F.col("_end")
    return rows.select(doc, (F.col("n") + 1).alias("line"), F.col("x._ls").alias("s"), front.alias("front"), (~front & ((F.col("x._fence") == 1) | (F.col("x._open") % 2 == 1))).alias("code"))


def _block(kind: str, raw: Column, **values: Column) -> Column:
    types = {"column": "int", "depth": "int", "text": "string", "number": "decimal(38,0)", "indent": "int", "cells": "array<string>", "target": "string"}
    return F.struct(F.lit(kind).alias("kind"), *((values[n] if n in values else F.lit(None)).cast(t).alias(n) for n, t in types.items()), raw.alias("raw"))


def cells_of(line: Column) -> Column:
    """Cells of a table row without the outer bars; a bar always separates."""
    return F.transform(F.split(F.regexp_replace(F.regexp_replace(stripped(line), r"^\|", ""), r"\|$", ""), r"\|", -1), stripped)


def links_of(line: Column) -> Column:
    """Inline links of a line, images left out: column, label, target (up to white space) and source."""

    def placed(found: Column) -> Column:
        gaps = F.transform(F.split(line, _LINK, -1), F.char_length)
        ends = scan(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + F.char_length(m)), lambda x, y: x + y)
        one = lambda m, e: _block("link", m, column=e - F.char_length(m), text=F.regexp_extract(m, r"^\[([^\]]*)\]", 1), target=F.regexp_extract(m, r"\]\(\s*([^)\s]*)[^)]*\)$", 1))
        return let(ends, lambda es: F.transform(found, lambda m, i: one(m, F.get(es, i))))

    return F.when(F.contains(line, F.lit("](")), let(F.regexp_extract_all(line, F.lit(_LINK), F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found))))


def markdown_blocks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line, kind, column, depth, text, number, indent, cells, target, raw of every block, each line's in the order of KINDS.

    A field of the front block has its name as text and its value as the one cell; a link has its label as text.
    """
    s = F.col("s")
    trimmed = stripped(s)
    bars = F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit("|"), F.lit("")))
    colon = F.instr(s, ":")
    closing = F.col("front") & (F.col("line") > 1) & (trimmed != "---") & (colon > 1)
    field = _block("front_field", s, column=F.lit(0), text=stripped(F.substring(s, F.lit(1), colon - 1)), cells=F.array(stripped(F.substring(s, colon + 1, F.char_length(s)))))
    heading = _block("heading", s, column=F.lit(0), depth=F.char_length(F.regexp_extract(s, _HEADING, 1)), text=F.regexp_extract(s, _HEADING, 2))
    indent = F.char_length(F.regexp_extract(s, _ITEM, 1))
    item = F.when(s.rlike(_ITEM), _block("ordered_list_item", s, column=indent, indent=indent, number=F.left(F.regexp_extract(s, _ITEM, 2), F.lit(38))))
    row = F.when(bars >= 2, _block("table_row", s, column=F.instr(s, "|") - 1, cells=cells_of(s)))
    none = F.array().cast(BLOCK)
    other = F.concat(F.array_compact(F.array(item, row)).cast(BLOCK), F.coalesce(links_of(s).cast(BLOCK), none))
    blocks = F.when(closing, F.array(field).cast(BLOCK)).when(F.col("front") | F.col("code"), none).when(s.rlike(_HEADING), F.array(heading).cast(BLOCK)).otherwise(other)
    return lines_of(docs, doc, text).select(doc, "line", F.explode(blocks).alias("b")).select(doc, "line", "b.*")


def front_fields(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, name, value of the front block; of repeated names the last counts."""
    own = markdown_blocks(docs, doc, text).where("kind = 'front_field'")
    return own.groupBy(doc, F.col("text").alias("name")).agg(F.max_by(F.get("cells", F.lit(0)), "line").alias("value"))
