"""Text functions as Column expressions: tokenizers, scores, headings, snippets, slugs, redaction."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS = 12


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: t != "")


def symbol_terms(query: str) -> list[str]:
    """Terms of a symbol query: at most twelve."""
    return [t for t in re.split("[^a-z0-9_]+", query.lower()) if t][:MAX_TERMS]


def docs_terms(query: str) -> list[str]:
    """Terms of a documentation query: slashes and dashes join, single characters go, at most twelve."""
    return [t for t in re.split("[^a-z0-9_/-]+", query.lower()) if len(t) > 1][:MAX_TERMS]


def phrases(terms: list[str]) -> list[list[str]]:
    """Each quoted term as the words that must follow one another."""
    return [[w for w in re.split("[/-]+", t) if w] for t in terms]


def text_score(text: Column, query: str, terms: list[str]) -> Column:
    """Number of terms contained, plus their number and two more where the whole query is."""
    low = F.lower(text)
    hits = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0))
    return hits + F.when(low.contains(query.lower()), len(terms) + 2).otherwise(0)


def field_boost(title: Column, path: Column, headings: Column, body: Column, query: str, terms: list[str]) -> Column:
    """headings: array of strings, scored as one text. One expression for all fields, so generated code stays small."""
    fields = F.array(title, path, F.array_join(headings, "\n"), body)
    weighted = F.zip_with(fields, F.array(*map(F.lit, (8, 6, 5, 1))), lambda x, w: text_score(x, query, terms) * w)
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def best_heading(headings: Column, query: str, terms: list[str]) -> Column:
    """struct(text, at) of the heading with the highest score, the earliest of equals; null when none scores."""
    scored = F.transform(headings, lambda h, i: F.struct(text_score(h, query, terms).alias("score"), (-i).alias("back"), h.alias("text")))
    top = F.array_max(scored)
    return F.when(top["score"] > 0, F.struct(top["text"].alias("text"), (-top["back"]).alias("at")))


def snippet(text: Column, query: str, terms: list[str]) -> Column:
    """Up to 70 characters before the first match and 130 after it, else the first 220; white space collapsed."""
    low = F.lower(text)
    at = F.instr(low, query.lower())
    for t in terms:
        at = F.when(at > 0, at).otherwise(F.instr(low, t))
    start = F.greatest(at - 70, F.lit(1))
    cut = F.when(at > 0, F.substring(text, start, at + 130 - start)).otherwise(F.substring(text, F.lit(1), F.lit(220)))
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower-cased, other than letters, digits, space and dash removed, spaces to dashes."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", "")), r"\s+", "-")


#: Characters between words of a normalised text.
GAP = r"[\p{P}\p{S}\p{Z}\s]"


def normalised(text: Column) -> Column:
    """NFKC form, lower-cased, with punctuation, symbols and separators as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(nfkc(text)), r"[\p{P}\p{S}\p{Z}]+", " "), r"\s+", " "))


def nfkc(text: Column) -> Column:
    """NFKC form; only texts with characters that it can change go through Python."""

    @F.pandas_udf("string")
    def form(values):
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return F.coalesce(form(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def leading_words(text: Column, n: int) -> Column:
    """The beginning of a text that holds its first n normalised words, however long the text is."""
    return F.regexp_extract(text, f"^{GAP}*(?:[^\\p{{P}}\\p{{S}}\\p{{Z}}\\s]+{GAP}*){{0,{n}}}", 0)


def concern_key(text: Column) -> Column:
    return F.replace(normalised(text), F.lit(" "), F.lit("-"))


def ngrams(words: Column, longest: int) -> Column:
    """All contiguous n-grams of an array of words up to a length: array<struct<term, start, n>>."""
    return F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(longest)),
            lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("term"), i.alias("start"), n.alias("n")))).otherwise(
                F.array().cast("array<struct<term:string,start:int,n:int>>")
            ),
        )
    )


def heading_lines(text: Column) -> Column:
    """array<struct<line, depth, text>> of ATX headings outside fenced code; lines from 1."""
    state = F.aggregate(
        F.transform(F.split(text, r"\r?\n"), lambda s, i: F.struct(s.alias("s"), (i + 1).alias("line"))),
        F.struct(F.lit(False).alias("code"), F.array().cast("array<struct<line:int,depth:int,text:string>>").alias("out")),
        lambda a, x: F.when(x["s"].rlike(r"^\s*(```|~~~)"), F.struct((~a["code"]).alias("code"), a["out"].alias("out")))
        .when(~a["code"] & x["s"].rlike(r"^#{1,6}\s+\S"), F.struct(a["code"].alias("code"), F.array_append(a["out"], F.struct(x["line"].alias("line"), F.char_length(F.regexp_extract(x["s"], "^(#+)", 1)).alias("depth"), F.trim(F.regexp_replace(x["s"], r"^#+\s+|\s+#+\s*$", "")).alias("text"))).alias("out")))
        .otherwise(a),
    )
    return state["out"]


def utf8_prefix(text: Column, most: int) -> Column:
    """Longest prefix of at most so many bytes that splits no character."""
    raw = F.substring(F.encode(text, "UTF-8"), F.lit(1), F.lit(most))
    # a cut character leaves a lead byte and fewer continuation bytes than it announces
    tail = F.substring(F.hex(raw), F.greatest(F.length(F.hex(raw)) - 5, F.lit(1)), F.lit(6))
    cut = F.when(tail.rlike(r"(?:^|..)(?:..)?F[0-7][89AB].[89AB].$"), 3).when(tail.rlike(r"^(?:..)*[EF].[89AB].$"), 2).when(tail.rlike(r"^(?:..)*[C-F].$"), 1).otherwise(0)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.lit(most) - cut), "UTF-8"))


#: Secret-like text and host paths that public output must not carry: expression, replacement.
REDACTIONS = [
    (r"(?i)\b(token|secret|password|passwd|api_?key)\b(\s*[:=]\s*)[\"']?[^\s\"']+[\"']?", "$1$2[redacted]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[redacted]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [redacted]"),
    (r"(?:/home|/Users|/root)/[^\s\"']+", "[path]"),
]


def redacted(text: Column, most_bytes: int | None = None) -> Column:
    """Text without secrets and host paths, of at most so many bytes; redaction comes first, so a cut shows no part of a secret."""
    for regex, put in REDACTIONS:
        text = F.regexp_replace(text, regex, put)
    return text if most_bytes is None else utf8_prefix(text, most_bytes)


def base64url(text: Column) -> Column:
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_"), F.lit("="))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value: the parser stops after the first, so it is tried inside an array and an object."""
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(inside, F.lit(False)) & text.rlike(r"\S")


def singular(word: Column) -> Column:
    """Naive: _ids goes, ies to y, a last s goes."""
    return F.when(word.endswith("_ids"), F.regexp_replace(word, "_ids$", "")).when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).otherwise(F.regexp_replace(word, "s$", ""))


def plural(word: Column) -> Column:
    """Ends in s: as it is; consonant and y: ies; ch, sh, x, z: es; else s."""
    return F.when(word.endswith("s"), word).when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies")).when(word.rlike("(ch|sh|x|z)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def pascal(word: Column) -> Column:
    return F.array_join(F.transform(F.split(word, "_+"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "")
