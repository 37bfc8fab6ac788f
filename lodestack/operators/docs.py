"""Document structure: titles, headings, sections, links, slugs and Markdown quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestack.functions import paths as P
from lodestack.functions import text as T

LINE, CELL = 100, 40


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def headings(html: Column) -> Column:
    """array<struct<depth, text>> of h1 to h6."""
    raw = F.regexp_extract_all(html, F.lit(r"(?s)(<h[1-6]>.*?)</h[1-6]>"), F.lit(1))
    return F.transform(raw, lambda h: F.struct(F.substring(h, 3, 1).cast("int").alias("depth"), F.substring(h, F.lit(5), F.length(h)).alias("text")))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def html_section(html: Column, depth: int) -> Column:
    """From the first heading of a depth to the next one of that depth or less, else to the end."""
    rest = F.substring(html, F.instr(html, f"<h{depth}>"), F.length(html))
    body = F.substring(rest, F.lit(5), F.length(rest))
    end = F.instr(F.regexp_replace(body, f"<h[1-{depth}]>", "<h0>"), "<h0>")
    return F.when(end > 0, F.substring(rest, F.lit(1), end + 3)).otherwise(rest)


def check_links(hrefs: DataFrame, href: str, targets: DataFrame, path: str) -> DataFrame:
    """hrefs with `found`."""
    t = targets.select(F.col(path).alias(href)).distinct().withColumn("_f", F.lit(True))
    return hrefs.join(t, href, "left").select(*hrefs.columns, F.col("_f").isNotNull().alias("found"))


def unique_slugs(df: DataFrame, doc: list[str], slug: str, order: str) -> DataFrame:
    """Repeated slugs of a document get -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy(*doc, slug).orderBy(order))
    return df.withColumn(slug, F.when(n == 1, F.col(slug)).otherwise(F.concat_ws("-", F.col(slug), n.cast("string"))))


def sections(h: DataFrame, doc: str, line: str, depth: str) -> DataFrame:
    """Headings with `skips` (a level is left out) and `until`, the line of the next heading that is not deeper.

    Depths run from 1 to 6, so the next heading of each depth is six windows over one sort of a document.
    """
    w = Window.partitionBy(doc).orderBy(line)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    until = F.lit(None).cast("long")
    for d in range(1, 7):
        nearest = F.min(F.when(F.col(depth) <= d, F.col(line))).over(after)
        until = F.when(F.col(depth) == d, nearest).otherwise(until)
    return h.select(doc, line, depth, F.coalesce(F.col(depth) > F.lag(depth).over(w) + 1, F.lit(False)).alias("skips"), until.alias("until"))


def nearest(left: DataFrame, key: str, path: str, right: DataFrame, other: str, other_path: str) -> DataFrame:
    """key, other, distance: for each left path the right path at the least segment distance, ties by other.

    A right path at distance d shares a leading directory; the deepest shared prefix decides, so both sides
    meet on prefixes: for every prefix only the shortest right path below it (and the least key) can win.
    """
    up = lambda df, k, p: df.select(F.col(k).alias(k), F.size(P.segments(F.col(p))).alias(f"_n_{k}"), F.explode(P.ancestors(F.col(p))).alias("_p"))
    best = up(right, other, other_path).groupBy("_p").agg(F.min(F.struct(F.col(f"_n_{other}").alias("n"), F.col(other).alias("k"))).alias("b"))
    depth = F.when(F.col("_p") == ".", 0).otherwise(F.size(F.split("_p", "/")))
    both = up(left, key, path).join(best, "_p").select(key, F.struct((F.col(f"_n_{key}") + F.col("b.n") - 2 * depth).alias("d"), F.col("b.k").alias("k")).alias("x"))
    return both.groupBy(key).agg(F.min("x").alias("x")).select(key, F.col("x.k").alias(other), F.col("x.d").cast("long").alias("distance"))


def markdown_lines(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, line, s, code: lines with whether they are in, or fence, a code block."""
    rows = docs.select(doc, F.posexplode(F.split(text, r"\r?\n")).alias("n", "s")).select(doc, (F.col("n") + 1).alias("line"), "s", F.col("s").rlike(r"^\s*(```|~~~)").alias("_fence"))
    w = Window.partitionBy(doc).orderBy("line")
    return rows.withColumn("_k", F.sum(F.col("_fence").cast("int")).over(w)).select(doc, "line", "s", (F.col("_fence") | (F.col("_k") % 2 == 1)).alias("code"))


def markdown_quality(docs: DataFrame, doc: str, text: str, known_paths: DataFrame | None = None, required: tuple[str, ...] = ("status",)) -> DataFrame:
    """Findings (doc, line, rule, detail) of six rules: front block, heading levels, repeated headings, list numbers, links, tables."""
    from lodestack.functions.authority import front_matter

    lines = markdown_lines(docs, doc, text).where(~F.col("code"))
    w = Window.partitionBy(doc).orderBy("line")
    out = docs.select(doc, F.lit(1).alias("line"), F.lit("required_frontmatter").alias("rule"), F.explode(F.array_except(F.array(*map(F.lit, required)), F.coalesce(F.map_keys(front_matter(F.col(text))), F.array().cast("array<string>")))).alias("detail"))
    h = lines.where(F.col("s").rlike(r"^#{1,6}\s+\S")).select(doc, "line", F.length(F.regexp_extract("s", "^(#+)", 1)).alias("depth"), F.trim(F.regexp_replace("s", r"^#+\s+|\s+#+\s*$", "")).alias("head"))
    out = out.unionByName(h.withColumn("before", F.lag("depth").over(w)).where("depth > before + 1").select(doc, "line", F.lit("skipped_heading_level").alias("rule"), F.col("head").alias("detail")))
    # the parent is the last heading of lesser depth: of each lesser depth the last line, the latest of them
    parent = F.lit(0)
    for d in range(1, 6):
        parent = F.greatest(parent, F.when(F.col("depth") > d, F.coalesce(F.last(F.when(F.col("depth") == d, F.col("line")), ignorenulls=True).over(w), F.lit(0))).otherwise(0))
    twice = h.withColumn("parent", parent).withColumn("n", F.row_number().over(Window.partitionBy(doc, "parent", "depth", F.lower("head")).orderBy("line")))
    out = out.unionByName(twice.where("n > 1").select(doc, "line", F.lit("duplicate_heading").alias("rule"), F.col("head").alias("detail")))
    item = lines.withColumn("num", F.regexp_extract("s", r"^(\s*)([0-9]+)[.)]\s", 2)).withColumn("ind", F.length(F.regexp_extract("s", r"^(\s*)", 1))).withColumn("prev", F.lag("num").over(w)).withColumn("prev_ind", F.lag("ind").over(w))
    wrong = (F.col("num") != "") & (F.col("prev") != "") & (F.col("ind") == F.col("prev_ind")) & (F.col("num").try_cast("int") != F.col("prev").try_cast("int") + 1) & ~((F.col("num") == "1") & (F.col("prev") == "1"))
    out = out.unionByName(item.where(wrong).select(doc, "line", F.lit("list_numbering").alias("rule"), F.col("num").alias("detail")))
    if known_paths is not None:
        hrefs = lines.select(doc, "line", F.explode(F.regexp_extract_all("s", F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))).alias("href")).where(~F.col("href").rlike(r"^([a-z][a-z0-9+.-]*:|#|/)"))
        at = hrefs.withColumn("_target", P.canonical(F.concat_ws("/", F.nullif(P.dirname(F.col(doc)), F.lit("")), F.regexp_replace("href", "[#?].*$", ""))))
        out = out.unionByName(at.join(known_paths.select(F.col("path").alias("_target")).distinct(), "_target", "left_anti").select(doc, "line", F.lit("broken_relative_link").alias("rule"), F.col("href").alias("detail")))
    cells = F.split(F.regexp_replace(F.trim("s"), r"^\||\|$", ""), r"(?<!\\)\|")
    table = lines.where(F.col("s").rlike(r"^\s*\|")).withColumn("n", F.size(cells)).withColumn("run", F.col("line") - F.row_number().over(w)).withColumn("first_n", F.first("n").over(Window.partitionBy(doc, "run").orderBy("line")))
    why = F.when(F.length("s") > LINE, "long line").when(F.exists(cells, lambda c: F.length(F.trim(c)) > CELL), "long cell").when(F.col("n") != F.col("first_n"), "column mismatch")
    return out.unionByName(table.withColumn("detail", why).where("detail IS NOT NULL").select(doc, "line", F.lit("table_readability").alias("rule"), "detail"))


def outline(docs: DataFrame, doc: str, text: str, most: int = 100) -> DataFrame:
    """doc, line, depth, text, heading_id of at most so many headings for each document."""
    h = docs.select(doc, F.explode(F.slice(T.heading_lines(F.col(text)), 1, most)).alias("h")).select(doc, "h.line", "h.depth", "h.text", T.slug(F.col("h.text")).alias("heading_id"))
    return unique_slugs(h, [doc], "heading_id", "line")


def read_section(docs: DataFrame, doc: str, text: str, heading_id: str, most_bytes: int = 4000) -> DataFrame:
    """doc, line, until, section: the text of one heading's section, cut at a number of bytes."""
    at = sections(outline(docs, doc, text), doc, "line", "depth").join(outline(docs, doc, text).where(F.col("heading_id") == heading_id).select(doc, "line"), [doc, "line"])
    body = F.array_join(F.slice(F.split(text, r"\r?\n"), F.col("line"), F.coalesce(F.col("until").cast("int"), F.lit(1 << 30)) - F.col("line")), "\n")
    return docs.select(doc, text).join(at.select(doc, "line", "until"), doc).select(doc, "line", "until", T.utf8_prefix(body, most_bytes).alias("section"))
