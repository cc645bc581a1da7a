"""Helpers on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, also where the body is applied per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Totals before each element and, last, over all: one element longer than the input.

    Two levels: totals of blocks first, then inside each block. Plain folding into a growing array
    would copy it once per element. The cube root of the length is the block size with the least work.
    """
    fold = lambda part, start: F.aggregate(part, start, add)
    size = F.size(values)

    def blocked(block: Column) -> Column:
        totals = F.transform(
            F.sequence(F.lit(0), F.floor(size / block).cast("int")),
            lambda b: fold(F.slice(values, b * block + 1, block), zero),
        )
        starts = lambda t: F.transform(
            F.sequence(F.lit(0), F.size(t) - 1), lambda b: fold(F.slice(t, F.lit(1), b), zero)
        )

        def inside(start: Column, b: Column) -> Column:
            last = F.least(block, size + 1 - b * block) - 1
            return F.transform(F.sequence(F.lit(0), last), lambda i: fold(F.slice(values, b * block + 1, i), start))

        return F.flatten(F.transform(let(totals, starts), inside))

    return let(F.greatest(F.ceil(F.cbrt(size)).cast("int"), F.lit(2)), blocked)
