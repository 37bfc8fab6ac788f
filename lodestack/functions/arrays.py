"""Arrays as Column expressions: a value bound once, running values in linear time.

Higher-order functions evaluate what their lambdas capture again for each element, and have no running sums: `let`
binds a value once, `scan` runs in blocks, so that long arrays cost time in proportion to their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a scan appends one by one before it starts a new block.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """array<int> of the running op (associative) over an array<int>: element i covers values 0 to i."""

    def run(part: Column) -> Column:
        return F.aggregate(part, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) == 0, x).otherwise(op(F.get(acc, F.size(acc) - 1), x)))))

    def blocks(v: Column) -> Column:
        own = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(BLOCK)).cast("int")), lambda k: run(F.slice(v, k * BLOCK + 1, F.lit(BLOCK))))

        def joined(bs: Column) -> Column:
            totals = run(F.transform(bs, lambda b: F.get(b, F.size(b) - 1)))
            return let(totals, lambda t: F.flatten(F.transform(bs, lambda b, i: F.when(i == 0, b).otherwise(F.transform(b, lambda x: op(F.get(t, i - 1), x))))))

        return let(own, joined)

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, run(v)).otherwise(blocks(v)))
