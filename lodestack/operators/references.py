"""References from and to symbols: edges of a node, deduplicated references, unresolved ones, and the composite page over all routes.

Every operator takes a table of targets, so one job answers for one symbol or for all of them. A symbol that a third of
all edges point to costs no task its edges: repeats fold where they lie, and only the rows that a page can
hold are dealt out by target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.operators.relational import distinct_edges

RANGE = ["start_line", "start_column", "end_line", "end_column"]
#: Confidence of hits that no edge stands for: fixed values.
AMBIGUOUS, UNRESOLVED, LEXICAL = 0.4, 0.35, 0.2
ROUTES = ["outgoing", "incoming", "unresolved", "lexical"]


def in_file_order(c: str) -> Column:
    """A null position comes first."""
    return F.coalesce(F.col(c), F.lit(-1))


def edges_of(edges: DataFrame, nodes: DataFrame, files: DataFrame, snapshot) -> DataFrame:
    """Edges whose source and target are nodes of files of a snapshot, with source_path and target_path."""
    own = nodes.join(files.where(F.col("snapshot_id") == F.lit(snapshot)).select("file_id", "path"), "file_id").select("node_id", "path")
    side = lambda k: own.select(F.col("node_id").alias(f"{k}_node_id"), F.col("path").alias(f"{k}_path"))
    return edges.where("target_node_id IS NOT NULL").join(side("source"), "source_node_id").join(side("target"), "target_node_id")


def page_of(df: DataFrame, key: str, order: list[Column], n: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + n of each key, with `position`."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("position", nth).where(F.col("position") <= offset + n).where(F.col("position") > offset)


def outgoing_edges(edges: DataFrame, targets: DataFrame, n: int = 50) -> DataFrame:
    """The first n edges of each node by edge id, repeats and all. targets: node_id."""
    own = edges.join(targets.select(F.col("node_id").alias("source_node_id")).distinct(), "source_node_id", "left_semi")
    return page_of(own, "source_node_id", [F.col("edge_id")], n)


_IDENTITY = ["source_node_id", "target_node_id", "kind", "provenance", "metadata"]


def outgoing_references(edges: DataFrame, targets: DataFrame, n: int = 50, offset: int = 0) -> DataFrame:
    """References from each node, without repeats, in nine-key order."""
    own = edges.where("target_node_id IS NOT NULL").join(targets.select(F.col("node_id").alias("source_node_id")).distinct(), "source_node_id", "left_semi")
    order = [F.col("source_node_id"), F.col("target_node_id"), *map(in_file_order, RANGE), F.col("kind"), F.col("provenance"), F.col("edge_id")]
    return page_of(distinct_edges(own, _IDENTITY, RANGE, "edge_id"), "source_node_id", order, n, offset)


def incoming_references(edges: DataFrame, targets: DataFrame, n: int = 50, offset: int = 0, with_self: bool = False) -> DataFrame:
    """References to each node, without repeats, in eight-key order; those of a node to itself only with_self."""
    own = edges.join(targets.select(F.col("node_id").alias("target_node_id")).distinct(), "target_node_id", "left_semi")
    own = own if with_self else own.where("source_node_id <> target_node_id")
    order = [F.col("source_node_id"), *map(in_file_order, RANGE), F.col("kind"), F.col("provenance"), F.col("edge_id")]
    return page_of(distinct_edges(own, _IDENTITY, RANGE, "edge_id"), "target_node_id", order, n, offset)


def unresolved_references(refs: DataFrame, targets: DataFrame, n: int = 50, offset: int = 0) -> DataFrame:
    """Unresolved references of each target: those that it makes and those that bear its name or qualified name.

    refs: ref_id, source_node_id, name, kind, path, the range and resolution; targets: node_id, name, qualified_name. The three
    conditions are three joins on equal keys; a reference that meets several counts once. References are folded and
    paged by their own key before they meet targets: a name that r references and t targets share costs r + t * (offset + n)
    rows. The order does not depend on the target, so what a page can hold is among the first rows of each key.
    """
    order = [F.col("path"), *map(in_file_order, RANGE), F.col("source_node_id"), F.col("name"), F.col("kind"), F.col("ref_id")]
    identity = ["source_node_id", "name", "kind", "path"]
    met = None
    for own, key in [("source_node_id", "node_id"), ("name", "name"), ("name", "qualified_name")]:
        asked = targets.select(F.col("node_id").alias("target"), F.col(key).alias("_t")).where("_t IS NOT NULL")
        once = distinct_edges(refs.join(asked.select(F.col("_t").alias(own)).distinct(), own, "left_semi"), identity, RANGE, "ref_id")
        part = page_of(once, own, order, offset + n).drop("position").join(asked, F.col(own) == F.col("_t")).drop("_t")
        met = part if met is None else met.unionByName(part)
    return page_of(distinct_edges(met, ["target", *identity], RANGE, "ref_id"), "target", order, n, offset)


def find_references(targets: DataFrame, edges: DataFrame, refs: DataFrame, lexical: DataFrame | None = None, n: int = 50) -> DataFrame:
    """The first n references of each target: target, position, route, source, path, range, kind, confidence, provenance, status, more.

    Outgoing references come first, then incoming, then unresolved ones. Lexical hits (target, path and range) stand in only for a
    target that has none of these, and never for a Ruby symbol that a parser found: there, nothing means nothing.
    targets: node_id, name, qualified_name, language, parsed (boolean).
    """
    none = F.lit(None)
    lines = [F.col(c) for c in RANGE]
    out = outgoing_references(edges, targets, n + 1).select(F.col("source_node_id").alias("target"), F.lit(0).alias("route"), "position", F.col("target_node_id").alias("other"), none.cast("string").alias("path"), *lines, F.lit("resolved").alias("kind"), "confidence", "provenance", F.lit("resolved").alias("status"))
    inc = incoming_references(edges, targets, n + 1).select(F.col("target_node_id").alias("target"), F.lit(1).alias("route"), "position", F.col("source_node_id").alias("other"), none.cast("string").alias("path"), *lines, "kind", "confidence", "provenance", F.lit("resolved").alias("status"))
    doubt = F.coalesce(F.col("resolution") == "ambiguous", F.lit(False))
    unres = unresolved_references(refs, targets, n + 1).select("target", F.lit(2).alias("route"), "position", F.col("source_node_id").alias("other"), "path", *lines, "kind", F.when(doubt, AMBIGUOUS).otherwise(UNRESOLVED).alias("confidence"), F.lit("unresolved_reference").alias("provenance"), F.when(doubt, "ambiguous").otherwise("unresolved").alias("status"))
    found = out.unionByName(inc).unionByName(unres)
    if lexical is not None:
        bare = targets.where(~(F.coalesce(F.col("language") == "ruby", F.lit(False)) & F.coalesce("parsed", F.lit(False)))).select(F.col("node_id").alias("target"))
        rest = page_of(lexical.join(bare, "target", "left_semi"), "target", [F.col("path"), F.col("start_line"), F.col("start_column")], n + 1)
        found = found.unionByName(rest.select("target", F.lit(3).alias("route"), "position", none.cast(dict(out.dtypes)["other"]).alias("other"), "path", *lines, F.lit("lexical").alias("kind"), F.lit(LEXICAL).alias("confidence"), F.lit("bounded_lexical_identifier_scan").alias("provenance"), F.lit("unresolved").alias("status")))
        found = found.withColumn("_first", F.min("route").over(Window.partitionBy("target"))).where("route < 3 OR _first = 3").drop("_first")
    nth = F.row_number().over(Window.partitionBy("target").orderBy("route", "position"))
    page = found.withColumn("position", nth).where(F.col("position") <= n + 1)
    more = F.max("position").over(Window.partitionBy("target")) > n
    return page.withColumn("more", more).where(F.col("position") <= n).withColumn("route", F.element_at(F.array(*map(F.lit, ROUTES)), F.col("route") + 1))


def coverage_receipt(files: DataFrame, exhausted: bool, continued: bool) -> DataFrame:
    """One row on a lexical scan: complete when the catalog is exhausted, nothing is continued and no searchable file stayed unread.

    files: classification ('searchable', 'policy_exclusion' or 'unresolved'), reason, bytes. Policy exclusions do not stand in the way.
    """
    left = F.count_if(F.col("classification") == "unresolved")
    return files.agg(
        (F.lit(exhausted and not continued) & (left == 0)).alias("complete"), F.count_if(F.col("classification") == "searchable").alias("searchable"), F.count_if(F.col("classification") == "policy_exclusion").alias("excluded"), left.alias("unresolved"),
        F.coalesce(F.sum(F.when(F.col("classification") == "searchable", F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def merged_reasons(pages: DataFrame) -> DataFrame:
    """Counts by class and reason over the pages of a scan. pages: classification, reason, n."""
    return pages.groupBy("classification", "reason").agg(F.sum("n").alias("n"))


def evidence_kinds(nodes: DataFrame, key: list[str]) -> DataFrame:
    """Sorted evidence kinds of the nodes of each key. nodes: the key and evidence_kinds (array)."""
    return nodes.select(*key, F.explode("evidence_kinds").alias("_kind")).groupBy(*key).agg(F.array_sort(F.collect_set("_kind")).alias("evidence_kinds"))
