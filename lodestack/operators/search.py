"""Full-text search: BM25, prefix search, phrase concerns, authority-aware ranking, frozen result universes."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as T
from lodestack.operators.relational import first_of, ranked
from lodestack.operators.term_index import B, K1, LEAST_IDF, TermIndex  # noqa: F401

BANDS = ["exact_document_phrase", "all_query_tokens_title_or_heading", "all_query_tokens_body", "intent_owner_match", "partial_fts_match"]
CANDIDATES = 500


def _hits(text: Column, term: str, prefix: bool) -> Column:
    """Occurrences of a term as a token, or as the beginning of one; texts that do not contain it are told without a search.

    A term with slashes or dashes is a phrase: its words as tokens that follow one another.
    """
    low, words = F.lower(text), [w for w in re.split("[/-]+", term) if w]
    if not words:
        return F.lit(0)
    regex = "(?<![a-z0-9_])" + "[^a-z0-9_]+".join(words) + ("" if prefix else "(?![a-z0-9_])")
    return F.when(low.contains(words[0]), F.regexp_count(low, F.lit(regex))).otherwise(F.lit(0))


def bm25(docs: DataFrame, fields: dict[str, float], terms: list[str], prefix: bool = False, every: bool = False) -> DataFrame:
    """docs with `score` (one of that name is replaced), the weighted BM25 of terms over the fields; only rows that hold a term.

    prefix: a term stands for all tokens that it begins; every: rows must hold every term. Two passes, and no array of
    tokens in either: one row of sums over the corpus comes back first (count, mean length, document frequencies);
    then only rows that contain a term are counted again. Terms consist of letters, digits, underscores, slashes and dashes. For many queries on
    one corpus, use TermIndex.
    """
    holds = lambda t: sum((_hits(F.col(f), t, prefix) for f in fields), F.lit(0)) > 0
    length = sum((F.coalesce(F.regexp_count(F.lower(F.col(f)), F.lit("[a-z0-9_]+")), F.lit(0)) for f in fields), F.lit(0))
    base = docs.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields])
    g = base.agg(F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean"), *(F.count_if(holds(t)).alias(f"df_{i}") for i, t in enumerate(terms))).first()
    tests = [holds(t) for t in terms]
    any_, all_ = F.lit(False), F.lit(True)
    for t in tests:
        any_, all_ = any_ | t, all_ & t
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        idf = max(math.log((g["n"] - g[f"df_{i}"] + 0.5) / (g[f"df_{i}"] + 0.5)), LEAST_IDF)
        tf = sum((_hits(F.coalesce(F.col(f).cast("string"), F.lit("")), t, prefix) * w for f, w in fields.items()), F.lit(0.0))
        total = total + idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / (g["mean"] or 1.0)))
    keep = [c for c in docs.columns if c != "score"]
    return docs.where((all_ if every else any_) & F.lit(bool(terms))).select(*keep, total.alias("score"))


#: Fields of a symbol and their weights in its full-text search.
SYMBOL_FIELDS = {"name": 8.0, "qualified_name": 7.0, "signature": 3.0, "docstring": 2.0}


def search_symbol_text(nodes: DataFrame, query: str, k: int = 50) -> DataFrame:
    """Symbols in which every term begins some token, with `score` and `rank`: by score, then name and node_id."""
    terms = T.symbol_terms(query)
    hits = bm25(nodes, SYMBOL_FIELDS, terms, prefix=True, every=True) if terms else nodes.withColumn("score", F.lit(0.0)).limit(0)
    return ranked(hits.withColumn("score", F.round("score", 6)), [F.desc("score"), F.asc("name"), F.asc("node_id")], k)


def _starts(prefix: str):
    return lambda x: x.startswith(prefix)


def prefix_and(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows in which every term is the prefix of some token."""
    toks = T.tokens(F.col(text))
    for t in terms:
        df = df.where(F.exists(toks, _starts(t)))
    return df


def phrase_at(text: Column, words: list[str]) -> Column:
    """Whether the words follow one another as tokens."""
    return F.concat(F.lit(" "), F.array_join(T.tokens(text), " "), F.lit(" ")).contains(" " + " ".join(words) + " ")


def union_candidates(fts: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Full-text and owner candidates by key with candidate_source; columns of the full-text copy win."""
    a = fts.withColumn("_f", F.lit(True))
    b = owners.select(key).distinct().withColumn("_o", F.lit(True))
    both = a.join(b, key, "full_outer")
    return both.select(*fts.columns, F.when(F.col("_f") & F.col("_o"), "fts_and_matched_owner").when(F.col("_f"), "fts").otherwise("matched_owner").alias("candidate_source"))


def resolve_phrases(queries: DataFrame, query_id: str, query: str, terms: DataFrame, term: str, longest: int) -> DataFrame:
    """Every n-gram of a normalised query that equals a term: query_id, term, start, n. An equi-join on n-grams."""
    words = queries.select(F.col(query_id), F.split(T.normalised(F.col(query)), " ").alias("_words"))
    grams = words.select(F.col(query_id), F.explode(T.ngrams(F.col("_words"), longest)).alias("_g")).select(query_id, "_g.term", "_g.start", "_g.n")
    return grams.join(terms.select(F.col(term).alias("term")).distinct(), "term").select(query_id, "term", "start", "n")


def relevance_band(query: str, title: Column, headings: Column, body: Column, in_fts: Column, is_owner: Column) -> Column:
    """Ordinal of BANDS."""
    import re

    toks = [w for w in re.split(r"[^\w]+|_", query.lower()) if w]
    head = T.normalised(F.concat_ws(" ", title, F.array_join(headings, " ")))
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    phrase = padded(head).contains(" " + " ".join(toks) + " ")
    holds = lambda c: F.size(F.array_except(F.array(*map(F.lit, toks)), F.split(c, " "))) == 0
    return F.when(in_fts & phrase, 0).when(in_fts & holds(head), 1).when(in_fts & holds(T.normalised(body)), 2).when(is_owner, 3).otherwise(4)


def owner_tier(states: Column, authority: Column, currency: Column) -> Column:
    """0: valid owner that is canonical and current; 1: other valid owner; 2: no owner state; 3: draft or conflicting; 4: the rest."""
    has = lambda *s: F.exists(states, lambda x: x.isin(*s))
    return F.when(has("valid") & (authority == "canonical") & (currency == "current"), 0).when(has("valid"), 1).when(F.coalesce(F.size(states), F.lit(0)) <= 0, 2).when(has("draft", "conflicting"), 3).otherwise(4)


def rank_reasons(most: int = 8) -> Column:
    """Why a candidate ranks where it does, as short texts in the order of the keys; columns as rank_order takes them, and candidate_source."""
    said = lambda label, c: F.concat(F.lit(label + ": "), F.replace(c.cast("string"), F.lit("_"), F.lit(" ")))
    lines = [
        F.when(F.col("owner_priority") == 0, F.lit("owner of a matched concern")), said("match", F.element_at(F.array(*map(F.lit, BANDS)), F.col("band") + 1)), F.when(F.col("owner_tier") < 2, said("owner tier", F.col("owner_tier"))), said("authority", F.col("authority")),
        said("currency", F.col("currency")), F.when(F.col("lexical").isNotNull(), said("lexical score", F.round("lexical", 3))), said("found by", F.col("candidate_source")),
    ]
    return F.slice(F.filter(F.array(*lines), lambda x: x.isNotNull()), 1, most)


AUTHORITIES, CURRENCIES = ["canonical", "supporting", "non_authoritative"], ["current", "unknown", "stale", "historical", "superseded"]


def rank_order(path: str = "path", ident: str = "doc_id") -> list[Column]:
    """The eight keys of a documentation rank: a total order."""
    at = lambda c, xs: F.array_position(F.array(*map(F.lit, xs)), F.col(c))
    return [F.col("owner_priority"), F.col("band"), F.col("owner_tier"), at("authority", AUTHORITIES), at("currency", CURRENCIES), F.desc_nulls_last("lexical"), F.col(path), F.col(ident)]


def rank_documents(candidates: DataFrame, k: int | None = CANDIDATES, path: str = "path", ident: str = "doc_id") -> DataFrame:
    return ranked(candidates, rank_order(path, ident), k)


class Universes:
    """Frozen ranked results under a folder: written once, addressed by id and position, expiring."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, universe_id: str, ranked_rows: DataFrame, expires_at: str) -> None:
        """Rows must carry `rank` from 1 without gaps; a header keeps their number and the expiry."""
        ranked_rows.write.mode("errorifexists").parquet(f"{self.folder}/{universe_id}/rows")
        n = self.spark.read.parquet(f"{self.folder}/{universe_id}/rows").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("rank"), F.lit(0)).alias("m")).first()
        if n["n"] != n["m"]:
            raise ValueError("ranks have gaps or repeats")
        self.spark.range(1, numPartitions=1).select(F.lit(n["n"]).alias("n"), F.lit(expires_at).cast("timestamp").alias("expires_at")).write.mode("errorifexists").parquet(f"{self.folder}/{universe_id}/header")

    def page(self, universe_id: str, start: int, n: int, now: str) -> DataFrame:
        """Rows start + 1 .. start + n; an expired universe is deleted and, like an unknown one, raises KeyError."""
        if not self._exists(universe_id):
            raise KeyError(universe_id)
        head = self.spark.read.parquet(f"{self.folder}/{universe_id}/header").select("n", (F.col("expires_at") <= F.lit(now).cast("timestamp")).alias("gone")).first()
        if head["gone"]:
            self.delete(universe_id)
            raise KeyError(universe_id)
        if not 0 <= start <= head["n"]:
            raise IndexError(start)
        return self.spark.read.parquet(f"{self.folder}/{universe_id}/rows").where(F.col("rank").between(start + 1, start + n)).orderBy("rank")

    def _path(self, universe_id: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{universe_id}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, universe_id: str) -> bool:
        fs, p = self._path(universe_id)
        return fs.exists(p)

    def purge(self, now: str) -> list[str]:
        """Deletes expired universes; gives their ids. Headers are one row each."""
        fs, p = self._path("")
        names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
        gone = []
        for name in sorted(names):
            if self._exists(f"{name}/header") and self.spark.read.parquet(f"{self.folder}/{name}/header").select((F.col("expires_at") <= F.lit(now).cast("timestamp")).alias("gone")).first()["gone"]:
                self.delete(name)
                gone.append(name)
        return gone

    def size(self, universe_id: str) -> int:
        if not self._exists(universe_id):
            raise KeyError(universe_id)
        return self.spark.read.parquet(f"{self.folder}/{universe_id}/header").first()["n"]

    def delete(self, universe_id: str) -> None:
        fs, p = self._path(universe_id)
        fs.delete(p, True)


def merged_terms(terms: DataFrame) -> DataFrame:
    """One row for each (concern, term, owner), that of the least source line."""
    return first_of(terms, ["concern_key", "term", "owner"], [F.col("source_line")])
