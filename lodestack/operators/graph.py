"""Property-graph operators over two DataFrames: traversal, impact, symbol search, resolution, references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import paths as P
from lodestack.functions.arrays import let, scan
from lodestack.operators.relational import numbered, ranked
from lodestack.operators.search import search_symbol_text


@dataclass
class Traversal:
    """Nodes in the order they were reached, edges in the order they were followed, the depth reached and whether a cap cut it."""

    nodes: list[tuple]  # node, depth
    edges: list[tuple]  # edge_id, source, target
    reached_depth: int
    truncated: bool


#: Ids that go into a filter as literals; more are broadcast.
LITERALS = 500


def walk(nodes: DataFrame, edges: DataFrame, start: list, max_depth: int = 2, max_nodes: int = 50, direction: str = "outgoing", mode: str = "expand") -> Traversal:
    """Bounded first-in-first-out traversal. nodes: node; edges: edge_id, source, target.

    A level is one filtered read of the edges and one of the nodes: the frontier has max_nodes ids at most, so it goes
    into the filters as literals, and max_nodes edges of a node at most come back. Outgoing edges follow edge id,
    incoming ones source and edge id. As a node is taken, max(1, max_nodes - nodes so far) of its edges count. Ids
    that are no nodes are skipped. mode "expand" goes on to the sources of incoming edges; "strict" lists these edges
    without going there.
    """

    def of(frontier: list, near: str, far: str, order: list[str]) -> DataFrame:
        own = edges.where(F.col(near).isin(frontier))
        nth = F.row_number().over(Window.partitionBy(near).orderBy(*order))
        return own.withColumn("_nth", nth).where(F.col("_nth") <= max_nodes).select(F.col(near).alias("near"), F.col(far).alias("far"), "edge_id", "source", "target", "_nth", F.lit(near == "target").alias("back"))

    known: dict = {}

    def exist(ids: set) -> None:
        new = [i for i in ids if i is not None and i not in known]
        if len(new) > LITERALS:
            asked = nodes.sparkSession.createDataFrame([(i,) for i in new], f"node {dict(nodes.dtypes)['node']}")
            own = nodes.join(F.broadcast(asked), "node", "left_semi")  # (max_nodes + 1) * 2 * max_nodes rows at most
        else:
            own = nodes.where(F.col("node").isin(new))
        found = {r[0] for r in own.select("node").distinct().collect()} if new else set()  # at most as many as asked
        known.update({i: i in found for i in new})

    exist(set(start))
    level = [i for i in dict.fromkeys(start) if known.get(i)]
    reached, out, seen_edges, taken, cut = [], [], set(), set(), False
    for depth in range(max_depth + 1):
        if not level:
            break
        by: dict = {}
        if depth < max_depth:
            ids = level[: max_nodes + 1]
            parts = [of(ids, "source", "target", ["edge_id"])] if direction in ("outgoing", "both") else []
            parts += [of(ids, "target", "source", ["source", "edge_id"])] if direction in ("incoming", "both") else []
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            for r in sorted(rows.collect(), key=lambda r: (r["back"], r["_nth"])):
                by.setdefault(r["near"], []).append(r)
            exist({r["far"] for rs in by.values() for r in rs})
        following = []
        for i in level:
            if len(reached) >= max_nodes:
                cut = True
                break
            if i in taken:
                continue
            taken.add(i)
            reached.append((i, depth))
            most = max(1, max_nodes - len(reached))
            counts = {False: 0, True: 0}
            for r in by.get(i, []):
                counts[r["back"]] += 1
                if counts[r["back"]] > most:
                    continue
                if r["edge_id"] not in seen_edges:
                    seen_edges.add(r["edge_id"])
                    out.append((r["edge_id"], r["source"], r["target"]))
                if known.get(r["far"]) and r["far"] not in taken and (not r["back"] or mode == "expand"):
                    following.append(r["far"])
        if cut:
            break
        level = following
    return Traversal(reached, out, max((d for _, d in reached), default=0), cut)


def traverse(nodes: DataFrame, edges: DataFrame, start: DataFrame, max_depth: int = 2, max_nodes: int = 50, direction: str = "outgoing", mode: str = "expand") -> DataFrame:
    """node, depth, rank and truncated of walk(); start: node, at most max_nodes + 1 of them are looked at."""
    ids = [r[0] for r in start.select("node").distinct().orderBy("node").limit(max_nodes + 1).collect()]
    t = walk(nodes, edges, ids, max_depth, max_nodes, direction, mode)
    return edges.sparkSession.createDataFrame([(n, d, k, t.truncated) for k, (n, d) in enumerate(t.nodes, 1)], f"node {dict(nodes.dtypes)['node']}, depth int, rank long, truncated boolean")


def traversed_edges(nodes: DataFrame, edges: DataFrame, start: list, **options) -> DataFrame:
    """edge_id, source, target, rank and reached_depth of walk(): the edges that it followed, in order."""
    t, types = walk(nodes, edges, start, **options), dict(edges.dtypes)
    return edges.sparkSession.createDataFrame([(*e, k, t.reached_depth) for k, e in enumerate(t.edges, 1)], f"edge_id {types['edge_id']}, source {types['source']}, target {types['target']}, rank long, reached_depth int")


def impact(nodes: DataFrame, edges: DataFrame, start, max_depth: int = 2, max_nodes: int = 50, direction: str = "both", missing: DataFrame | None = None) -> DataFrame:
    """One row: what a change to a node may reach, and how far that can be trusted.

    nodes: node, path, evidence_kinds (array); edges: edge_id, source, target, provenance, confidence. missing: paths
    that are gone; when the traversal touches one, the row is empty with confidence low/empty and stale true.
    Raises KeyError when there is no such node.
    """
    t = walk(nodes, edges, [start], max_depth, max_nodes, direction)
    if not t.nodes:
        raise KeyError(start)
    spark = nodes.sparkSession
    own = nodes.where(F.col("node").isin([n for n, _ in t.nodes])).select("node", "path", "evidence_kinds")
    kinds = own.agg(F.count(F.lit(1)).alias("symbols"), F.array_sort(F.collect_set("path")).alias("files"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_kinds")))).alias("evidence_kinds"))
    used = edges.where(F.col("edge_id").isin([e[0] for e in t.edges])).agg(F.count(F.lit(1)).alias("edges"), F.coalesce(F.bool_or(F.col("provenance").contains("cloudformation")), F.lit(False)).alias("cf"), F.coalesce(F.bool_or(F.col("confidence") < 0.7), F.lit(False)).alias("low"))
    stale = F.lit(False)
    if missing is not None:
        stale = F.lit(not own.join(missing.select("path"), "path", "left_semi").isEmpty())
    both = kinds.join(used, F.lit(True))  # one row each
    level = F.when(stale | (F.col("edges") == 0), "low/empty").when(F.size("files") <= 1, "low/local_only").when(F.col("cf") | F.col("low"), "low/graph").when(F.lit(t.truncated), "medium/graph").otherwise("high/graph")
    shown = F.when((F.col("edges") > 0) & (F.size("files") > 1) & F.col("cf"), F.array(F.lit("config"), F.lit("infra_parser"))).otherwise(F.col("evidence_kinds"))
    void = F.array().cast("array<string>")
    return both.select(
        F.lit(start).alias("start"), F.when(stale, F.lit(0)).otherwise(F.col("symbols")).cast("long").alias("symbols"), F.when(stale, void).otherwise(F.col("files")).alias("files"), F.when(stale, F.lit(0)).otherwise(F.col("edges")).cast("long").alias("edges"),
        F.when(stale, F.lit(0)).otherwise(F.lit(t.reached_depth)).alias("reached_depth"), F.lit(t.truncated).alias("truncated"), level.alias("confidence"), F.when(stale, void).otherwise(shown).alias("evidence_kinds"), stale.alias("stale"),
    )


def impact_confidence(edges: DataFrame, key: list[str], file: str, provenance: str, confidence: str, truncated: Column) -> DataFrame:
    """By key: number of edges and files, and the confidence that they support."""
    out = edges.groupBy(*key).agg(F.count(provenance).alias("edges"), F.count_distinct(file).alias("files"), F.coalesce(F.bool_or(F.col(provenance) == "cloudformation"), F.lit(False)).alias("_cf"), F.coalesce(F.bool_or(F.col(confidence) < 0.7), F.lit(False)).alias("_low"), F.coalesce(F.bool_or(truncated), F.lit(False)).alias("_cut"))
    level = F.when(F.col("edges") == 0, "low/empty").when(F.col("files") <= 1, "low/local_only").when(F.col("_cf") | F.col("_low"), "low/graph").when(F.col("_cut"), "medium/graph").otherwise("high/graph")
    return out.select(*key, "edges", "files", level.alias("confidence"))


def search_symbols(nodes: DataFrame, query: str, languages: list[str] | None = None, k: int = 20) -> DataFrame:
    """Exact names and qualified names first; where there is none, substring matches flagged exact_miss.

    nodes: node_id, name, qualified_name, language, path. Both branches are one pass: a match class per
    row, and the better class wins by its minimum.
    """
    q = query.lower()
    own = nodes if not languages else nodes.where(F.col("language").isin(languages))
    name, qn = F.lower("name"), F.lower(F.coalesce("qualified_name", F.lit("")))
    rank = F.when(F.col("name") == query, 0).when(F.coalesce(F.col("qualified_name") == query, F.lit(False)), 1).when(name == q, 2).when(qn == q, 3).when(name.contains(q) | qn.contains(q), 10)
    top = own.withColumn("match", rank).where("match IS NOT NULL")
    top = ranked(top, [F.col("match"), F.col("name"), F.col("path"), F.col("node_id")], k)
    miss = F.min("match").over(Window.partitionBy()) >= 10
    return top.withColumn("exact_miss", miss).where(F.col("exact_miss") | (F.col("match") < 10))


def find_symbols(nodes: DataFrame, query: str, languages: list[str] | None = None, k: int = 20) -> DataFrame:
    """node_id, name, path, match, rank, exact_miss: exact names, else exact names of resource-backed symbols, else full text.

    nodes: node_id, name, qualified_name, language, path, signature, docstring, resource_backed (boolean). A language
    filter does not hold back resource-backed symbols, whose language is that of their template.
    """
    cols = ["node_id", "name", "path", "match", "rank", "exact_miss"]
    exact = search_symbols(nodes, query, languages, k).where(~F.col("exact_miss"))
    if not exact.isEmpty():
        return exact.select(*cols)
    backed = search_symbols(nodes.where(F.coalesce("resource_backed", F.lit(False))), query, None, k).where(~F.col("exact_miss"))
    if not backed.isEmpty():
        return backed.select(*cols)
    own = nodes if not languages else nodes.where(F.col("language").isin(languages))
    return search_symbol_text(own, query, k).select("node_id", "name", "path", F.lit(10).alias("match"), "rank", F.lit(True).alias("exact_miss"))


#: Kinds of node that a reference of a kind may mean; other kinds of reference may mean any.
FITS = {
    "type": (("inheritance", "include", "extend", "prepend", "model_dsl"), ("class", "module")),
    "method": (("call",), ("method", "singleton_method")),
    "constant": (("constant",), ("class", "module", "constant")),
    "route": (("route",), ("class", "method")),
}


def resolve_references(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of references with exactly one candidate, and why the others stay unresolved.

    refs: ref_id, source, name, kind, language, static, receiver (import_selector, receiver_or_package_local or null),
    import_dir, paths (array); nodes: node_id, name, qualified_name, kind, language, path. Narrowing comes before
    the count: a narrower pool is used when it is not empty. A Ruby require means the module of the file whose path ends in
    its name; require_relative starts from the folder of source_path, where refs have that column. Nodes are counted by name, by name and directory, by
    qualified name and by path before they meet references, so every join is on a unique key: a name that many
    references and many nodes share costs their sum, not their product.
    """
    low = nodes.select("node_id", F.lower("name").alias("_key"), F.lower(F.coalesce("qualified_name", F.lit(""))).alias("_qn"), "kind", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("_dir"))
    of = lambda test, name: [F.count_if(test).alias(f"_n_{name}"), F.min(F.when(test, F.col("node_id"))).alias(f"_id_{name}")]
    some = F.lit(True)
    named = low.groupBy("_key").agg(*of(some, "all"), *of(F.col("kind") == "method", "methods"))
    placed = low.where("kind <> 'method'").groupBy("_key", "_dir").agg(*of(some, "dir"))
    full = low.groupBy("_key", "_qn").agg(*of(some, "any"), *(c for k, (_, kinds) in FITS.items() for c in of(F.col("kind").isin(*kinds), k)))
    filed = low.groupBy("path").agg(*of(some, "file"))

    name = F.replace(F.lower("name"), F.lit("::"), F.lit("."))
    own = refs.withColumn("_qn", name).withColumn("_key", F.element_at(F.split(name, r"\."), -1)).withColumn("_dir", F.when(F.col("receiver") == "import_selector", F.col("import_dir")))
    handler, ruby = F.col("kind") == "lambda_handler_file", F.col("language") == "ruby"
    by_file = own.where(handler).select("ref_id", F.explode(F.array_distinct("paths")).alias("path")).join(filed, "path").groupBy("ref_id").agg(F.sum("_n_file").alias("_n_file"), F.min("_id_file").alias("_id_file"))
    stem = F.regexp_replace(F.lower("path"), r"\.rb$", "")
    modules = nodes.where((F.col("language") == "ruby") & (F.col("kind") == "module")).select("node_id", F.split(stem, "/").alias("_parts"))
    suffixed = modules.select("node_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda i: F.array_join(F.slice("_parts", i, F.size("_parts")), "/"))).alias("_file")).groupBy("_file").agg(*of(some, "required"))
    own_dir = P.dirname(F.lower("source_path")) if "source_path" in refs.columns else F.lit("")
    named_file = F.regexp_replace(F.lower("name"), r"\.rb$", "")
    own = own.withColumn("_file", F.when(F.col("kind") == "require", named_file).when(F.col("kind") == "require_relative", P.canonical(F.concat_ws("/", F.nullif(own_dir, F.lit("")), named_file))))
    by_qn = full.select("_key", "_qn", *(F.col(c) for c in full.columns if c not in ("_key", "_qn")))
    out = own.join(named, "_key", "left").join(placed, ["_key", "_dir"], "left").join(by_qn, ["_key", "_qn"], "left").join(by_file, "ref_id", "left").join(suffixed, "_file", "left")

    def pick(which: str) -> Column:
        """struct(n, id) of a pool."""
        return F.struct(F.coalesce(f"_n_{which}", F.lit(0)).cast("long").alias("n"), F.col(f"_id_{which}").alias("id"))

    qualified = None
    for k, (kinds, _) in FITS.items():
        test = F.col("kind").isin(*kinds)
        qualified = F.when(test, pick(k)) if qualified is None else qualified.when(test, pick(k))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast(dict(nodes.dtypes)["node_id"]).alias("id"))
    pool = (
        F.when(handler, pick("file"))
        .when(ruby & F.coalesce("static", F.lit(False)) & (F.col("_n_required") > 0), pick("required"))
        .when(ruby, F.when(F.coalesce("static", F.lit(False)), qualified.otherwise(pick("any"))).otherwise(nothing))
        .when((F.col("receiver") == "import_selector") & (F.col("_n_dir") > 0), pick("dir"))
        .when((F.col("receiver") == "receiver_or_package_local") & (F.col("_n_methods") > 0), pick("methods"))
        .otherwise(pick("all"))
    )
    n = F.col("_pool.n")
    return out.withColumn("_pool", pool).select("ref_id", "source", F.when(n == 1, F.col("_pool.id")).alias("target"), F.when(handler, "routes_to_handler_file").otherwise(F.col("kind")).alias("kind"), n.alias("candidate_count"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved").alias("resolution"))


def lexical_references(docs: DataFrame, ident: str, text: str, word: str, id_out: str = "path") -> DataFrame:
    """Occurrences of an identifier: id, line from 1, column from 0. The identifier means itself, whatever characters it has.

    Lines are split once; columns are running sums over the pieces between occurrences, so the work is in proportion to the text.
    """
    edge = "(?<![A-Za-z0-9_])" + quoted(word) + "(?![A-Za-z0-9_])"
    lines = docs.where(F.col(text).contains(word)).select(F.col(ident).alias(id_out), F.posexplode(F.split(text, "\r?\n")).alias("n", "line_text")).where(F.col("line_text").contains(word))
    lengths = F.transform(F.split("line_text", edge, -1), F.char_length)
    at = let(scan(lengths, lambda x, y: x + y), lambda ends: F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda e, k: e + k * len(word)))
    return lines.select(id_out, (F.col("n") + 1).alias("line"), F.explode(at).alias("col"))


def quoted(word: str) -> str:
    """Regular expression of a word that means itself."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def handler_groups(hits: DataFrame, anchors: DataFrame) -> DataFrame:
    """All handler bindings by template, logical id and kind, each followed by its handler files.

    hits: node_id, template, logical_id, kind_rank; anchors: node_id, binding (node_id of the binding). A file
    sorts by the key of its binding; a node found more than once keeps its first place.
    """
    key = F.struct("template", "logical_id", "kind_rank", F.col("node_id").alias("binding"))
    own = hits.select("node_id", key.alias("key"))
    files = anchors.join(own.select(F.col("node_id").alias("binding"), "key"), "binding").select("node_id", "key", F.lit(1).alias("file"))
    both = own.select("node_id", "key", F.lit(0).alias("file")).unionByName(files).groupBy("node_id").agg(F.min(F.struct("key", "file")).alias("at"))
    return numbered(both, [F.col("at"), F.col("node_id")]).select("node_id", "rank")
