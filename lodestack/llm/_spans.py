"""Spans of regular expressions as Column expressions: code-point positions without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.arrays import let, scan

SPAN = "array<struct<s:int,e:int,m:string,b:string,a:string>>"
#: Characters of context before a match.
CONTEXT = 24


def matches(text: Column, regex: str) -> Column:
    """Non-overlapping matches from the left as array<struct<s, e, m, b, a>>.

    s and e in code points, e exclusive; b the characters before, back to the match before at most; a the next
    character. Pieces between matches and the matches themselves alternate, so positions are running lengths.
    The expression must not match the empty string.
    """

    def placed(ps: Column, ms: Column) -> Column:
        lengths = F.zip_with(F.slice(ps, F.lit(1), F.size(ms)), ms, lambda p, m: F.char_length(p) + F.char_length(m))

        def one(m: Column, i: Column, ends: Column) -> Column:
            e = F.get(ends, i)
            after = F.concat(F.get(ps, i + 1), F.coalesce(F.get(ms, i + 1), F.lit("")))
            return F.struct((e - F.char_length(m)).alias("s"), e.alias("e"), m.alias("m"), F.right(F.get(ps, i), F.lit(CONTEXT)).alias("b"), F.left(after, F.lit(1)).alias("a"))

        return let(scan(lengths, lambda x, y: x + y), lambda ends: F.transform(ms, lambda m, i: one(m, i, ends)))

    found = let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, let(F.split(text, regex, -1), lambda ps: placed(ps, ms))))
    return F.coalesce(found, none())


def none() -> Column:
    return F.array().cast(SPAN)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    n = F.char_length(d)
    total = F.aggregate(
        F.transform(F.split(d, ""), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") >= 5, 1).otherwise(0))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def tagged(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("o"), x["e"].alias("e"), F.lit(kind).alias("k")))


TAGGED = "array<struct<s:int,o:int,e:int,k:string>>"


def joined(spans: Column) -> Column:
    """kind:start:end of tagged spans, by start and then kind order, comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def news(base: Column, chosen: Column) -> Column:
    """The chosen spans (s, o, e, k, z) that do not lie inside a base span or another chosen one, tagged.

    Spans that overlap only in part all stay. Of equal spans the one with the largest z stays, then the least o.
    """
    row = lambda x, own, z: F.struct(x["s"].alias("s"), (-x["e"]).alias("ne"), F.lit(own).alias("own"), z.alias("nz"), x["o"].alias("o"), x["k"].alias("k"))
    both = F.array_sort(F.concat(F.transform(base, lambda x: row(x, 0, F.lit(0.0))), F.transform(chosen, lambda x: row(x, 1, -x["z"]))))

    def kept(rows: Column) -> Column:
        reach = scan(F.transform(rows, lambda x: -x["ne"]), F.greatest)
        new = let(reach, lambda far: F.filter(rows, lambda x, i: (x["own"] == 1) & ((i == 0) | (F.get(far, i - 1) < -x["ne"]))))
        return F.transform(new, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), (-x["ne"]).alias("e"), x["k"].alias("k")))

    return F.when(F.size(chosen) > 0, let(both, kept)).otherwise(F.array().cast(TAGGED))


def outside(spans: Column, base: Column, least: int) -> Column:
    """The parts of spans (disjoint, of matches) of at least so many characters that no base span covers, as array<struct<s, e, m>>.

    Ends and starts of both are sorted; running sums tell the stretches that a span covers and no base span does.
    """
    none_ = F.array().cast("array<struct<s:int,e:int,m:string>>")
    mark = lambda at, span, cover, i: F.struct(at.alias("at"), F.lit(span).alias("d"), F.lit(cover).alias("c"), i.alias("i"))
    marks = F.array_sort(
        F.concat(
            F.flatten(F.transform(spans, lambda x, i: F.array(mark(x["s"], 1, 0, i), mark(x["e"], -1, 0, F.lit(-1))))),
            F.flatten(F.transform(base, lambda x: F.array(mark(x["s"], 0, 1, F.lit(-1)), mark(x["e"], 0, -1, F.lit(-1))))),
        )
    )

    def parts(ms: Column, xs: Column, d: Column, c: Column, own: Column) -> Column:
        def part(m: Column, i: Column) -> Column:
            x = F.get(xs, F.get(own, i))
            end = F.get(ms, i + 1)["at"]
            good = (F.get(d, i) > 0) & (F.get(c, i) == 0) & (end - m["at"] >= least)
            return F.when(good, F.struct(m["at"].alias("s"), end.alias("e"), F.substring(x["m"], m["at"] - x["s"] + 1, end - m["at"]).alias("m")))

        return F.filter(F.transform(ms, part), lambda x: x.isNotNull())

    add = lambda x, y: x + y
    run = lambda ms, f, op, body: let(scan(F.transform(ms, f), op), body)
    cut = let(spans, lambda xs: let(marks, lambda ms: run(ms, lambda m: m["d"], add, lambda d: run(ms, lambda m: m["c"], add, lambda c: run(ms, lambda m: m["i"], F.greatest, lambda own: parts(ms, xs, d, c, own))))))
    whole = F.transform(F.filter(spans, lambda x: x["e"] - x["s"] >= least), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))
    return F.when(F.size(spans) == 0, none_).when(F.size(base) == 0, whole).otherwise(cut)
