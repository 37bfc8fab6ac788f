"""License scans: phrases of licenses, and an exact set-similarity join of text blocks with license templates.

A text is lower-cased and cut into words; a block is a stretch of BLOCK words, and blocks begin every STEP words, so whatever
is STEP words long or less lies whole in one of them. The set of a block or template is that of its pairs of adjacent words.
A template is found in a block that holds at least `threshold` of the template's pairs.

The join is exact. Pairs have one global order, by the number of documents that hold them, rare ones first. A template
of s pairs of which `need` must be there is indexed under its first s - need + 1 pairs (prefix filter); a block looks its
pairs up in that index, of which those that leave fewer than `need` pairs go (length and positional filters);
candidates are verified on their whole sets. Documents without a pair of any prefix are not cut into blocks at all.
Pairs that no template has cannot count, so they are left out of blocks before anything is compared.

Templates are a parameter of bounded size (MOST_PAIRS): they and their index are literals of the plan. All work stays in the
row of its document: there is no shuffle, but for one count of the template pairs over all documents.

Defined cases: null and empty texts have no words, labels or places and score 0; equal rows give equal rows; null ids are kept;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm._spark import table

THRESHOLD = 0.8
#: Words of a block, and from the start of one to the next. Words of a stretch whose pairs are looked at together when documents are sifted.
BLOCK, STEP, STRETCH = 96, 48, 512
#: Distinct pairs of all templates.
MOST_PAIRS = 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences by which public licenses are granted, and their labels.
TEMPLATES = [
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def pairs_of(text: str) -> list[str]:
    """The distinct pairs of adjacent words of a template, in order."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def need_of(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def _texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def _pairs(words: Column, start: Column, count: int) -> Column:
    """Pairs of adjacent words among `count` words from `start` (from 0) on, as "a b"; the last word of a shorter stretch stands alone."""
    return F.zip_with(F.slice(words, start + 1, F.lit(count - 1)), F.slice(words, start + 2, F.lit(count - 1)), lambda a, b: F.concat_ws(" ", a, b))


def _starts(words: Column, step: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / F.lit(step)).cast("int")), lambda k: k * step)


def worded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, joined, words): words lower-cased and, joined, each with a space before it."""
    lower = F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER)
    joined = F.trim(F.regexp_replace(lower, _BREAK, " "))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), joined.alias("joined"))
    none = F.array().cast("array<string>")
    return base.select("doc_id", "joined", F.when(F.col("joined") == "", none).otherwise(F.split("joined", " ")).alias("words"))


def document_frequencies(texts: DataFrame, pairs: list[str]) -> dict[str, int]:
    """Documents of worded() that hold each pair; at most so many rows come back as there are pairs."""
    held = F.transform(_starts(F.col("words"), STRETCH), lambda k: F.array_intersect(_texts(pairs), _pairs(F.col("words"), k, STRETCH + 1)))
    seen = texts.select(F.explode(F.array_distinct(F.flatten(held))).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return {r["pair"]: r["n"] for r in seen.collect()}


class Templates:
    """Templates in the global order, with the index of their prefixes. df: documents by pair."""

    def __init__(self, templates: list[tuple[str, str]], threshold: float, df: dict[str, int]):
        self.labels = [label for label, _ in templates]
        sets = [pairs_of(text) for _, text in templates]
        self.order = sorted(set().union(*sets), key=lambda p: (df.get(p, 0), p))
        rank = {p: i for i, p in enumerate(self.order)}
        self.sets = [sorted(s, key=rank.__getitem__) for s in sets]
        self.need = [need_of(len(s), threshold) for s in self.sets]
        self.index: dict[str, list[tuple[int, int]]] = {}
        for t, (s, need) in enumerate(zip(self.sets, self.need)):
            for j, p in enumerate(s[: len(s) - need + 1]):
                self.index.setdefault(p, []).append((t, j))

    def sift(self, words: Column) -> Column:
        """Whether any stretch holds a pair of a prefix."""
        return F.exists(_starts(words, STRETCH), lambda k: F.arrays_overlap(_texts(list(self.index)), _pairs(words, k, STRETCH + 1)))

    def found(self, words: Column) -> Column:
        """array<struct<template, block, held>>: the templates found in each block, and how many of their pairs are there."""
        entry = lambda t, j: F.struct(F.lit(t).alias("t"), F.lit(j).alias("j"), F.lit(len(self.sets[t])).alias("size"), F.lit(self.need[t]).alias("need"))
        index = F.map_from_arrays(_texts(list(self.index)), F.array(*(F.array(*(entry(t, j) for t, j in at)) for at in self.index.values())))
        sets = F.array(*(_texts(s) for s in self.sets))

        def candidates(x: Column) -> Column:
            fits = lambda e, i: F.lit(1) + F.least(F.size(x) - i - 1, e["size"] - e["j"] - 1) >= e["need"]
            each = F.transform(x, lambda p, i: F.transform(F.filter(F.try_element_at(index, p), lambda e: fits(e, i)), lambda e: F.struct(e["t"].alias("t"), e["need"].alias("need"))))
            return F.array_distinct(F.flatten(F.filter(each, lambda a: a.isNotNull())))

        def verified(x: Column, k: Column) -> Column:
            held = F.transform(candidates(x), lambda c: F.struct(c["t"].alias("template"), k.alias("block"), F.size(F.array_intersect(x, F.get(sets, c["t"]))).alias("held"), c["need"].alias("need")))
            return F.filter(held, lambda h: h["held"] >= h["need"])

        blocks = F.transform(_starts(words, STEP), lambda k: F.struct(k.alias("k"), F.array_intersect(_texts(self.order), _pairs(words, k, BLOCK)).alias("x")))
        return F.flatten(F.transform(F.filter(blocks, lambda b: F.size(b["x"]) > 0), lambda b: verified(b["x"], b["k"])))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    n_base counts the places where a phrase stands, first_word and last_word are the first and last start of one. found has
    (label, template, block, containment) of each template found in the block that begins at that word; score is the greatest
    containment, 1 where a phrase stands, 0 where nothing is found.
    """
    templates = TEMPLATES if templates is None else templates
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    every = set().union(*(pairs_of(t) for _, t in templates))
    if len(every) > MOST_PAIRS or any(len(pairs_of(t)) < 1 or len(t.split()) > STEP for _, t in templates):
        raise ValueError(f"templates need 2 to {STEP} words each and may have {MOST_PAIRS} pairs in all")
    texts = worded(docs, id_col, text_col)
    known = Templates(templates, threshold, document_frequencies(texts, sorted(every)))
    padded = F.concat(F.lit(" "), F.col("joined"), F.lit(" "))
    spaces = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))
    stands = {p: F.contains(F.col("joined"), F.lit(p)) & F.contains(padded, F.lit(f" {p} ")) for p in PHRASES}
    places = F.split(padded, f" (?=(?:{'|'.join(PHRASES)}) )")
    kind = "array<struct<template:int,block:int,held:int,need:int>>"
    hits = F.when(known.sift(F.col("words")), known.found(F.col("words"))).otherwise(F.array().cast(kind)) if templates else F.array().cast(kind)
    base = texts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.array_compact(F.array(*(F.when(stands[p], F.lit(label)) for p, label in PHRASES.items()))).alias("own"),
        F.when(F.contains(F.col("joined"), F.lit("license")) | F.contains(F.col("joined"), F.lit("cc by")), places).alias("places"),
        hits.alias("hits"),
    )
    n_base = F.coalesce(F.size("places") - 1, F.lit(0)).cast("long")
    some = F.size("places") > 1
    labels, sizes = _texts(known.labels), F.array(*(F.lit(float(len(s))) for s in known.sets)) if templates else F.array().cast("array<double>")
    row = lambda h: F.struct(F.get(labels, h["template"]).alias("label"), h["template"].alias("template"), h["block"].alias("block"), (h["held"] / F.get(sizes, h["template"])).alias("containment"))
    out = base.withColumn("found", F.transform("hits", row))
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.when(some, spaces(F.get("places", F.lit(0)))).cast("long").alias("first_word"),
        F.when(some, F.col("n_words") - spaces(F.get("places", F.size("places") - 1))).cast("long").alias("last_word"),
        listed(F.col("own")).alias("base_labels"),
        listed(F.concat("own", F.transform("found", lambda f: f["label"]))).alias("labels"),
        F.when(some, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda f: f["containment"])), F.lit(0.0))).alias("score"),
        "found",
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("found")


def _sql() -> str:
    """Every block against every template, without order or filters."""
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    phrase = lambda p: f"words[i + 1:i + {len(p.split())}] = {listed(p.split())}"
    sets = ",\n    ".join(f"('{label}', {listed(pairs_of(t))}, {need_of(len(pairs_of(t)), THRESHOLD)})" for label, t in TEMPLATES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), p AS (
  SELECT r, doc_id, len(words) AS n_words, {", ".join(f"list_filter(range(len(words)), lambda i: {phrase(p)}) AS p{k}" for k, p in enumerate(PHRASES))} FROM d
), t(label, pairs, need) AS (VALUES
    {sets}
), k AS (
  SELECT r, words, unnest(range(0, len(words), {STEP})) AS k FROM d
), b AS (
  SELECT r, list_distinct(list_transform(range(k, least(k + {BLOCK} - 1, len(words) - 1)), lambda i: words[i + 1] || ' ' || words[i + 2])) AS pairs FROM k
), f AS (
  SELECT r, label, len(list_intersect(b.pairs, t.pairs)) AS held, len(t.pairs) AS size FROM b, t WHERE len(list_intersect(b.pairs, t.pairs)) >= need
), m AS (
  SELECT r, list(DISTINCT label) AS labels, max(held::DOUBLE / size) AS score FROM f GROUP BY r
), o AS (
  SELECT p.*, p0 || p1 || p2 || p3 AS places, list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(PHRASES.values()))}], lambda x: x IS NOT NULL) AS own FROM p
)
SELECT doc_id, n_words, len(places) AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(list_distinct(own)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(own || coalesce(labels, []))), ',') AS labels,
       CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score
FROM o LEFT JOIN m USING (r)
"""


SQL = _sql()
