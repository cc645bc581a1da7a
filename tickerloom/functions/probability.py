"""Row-local arithmetic on three class probabilities."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickerloom.functions.vocab import SENTIMENTS

_TINY = 1e-9


def rounded(value: Column, places: int) -> Column:
    """Half-to-even on the decimal text. Python rounds the binary value: 2.675 is 2.68 here, 2.67 there."""
    return F.bround(value, places)


def argmax3(p0: Column, p1: Column, p2: Column) -> Column:
    """Index of the largest probability; ties go to the lowest index; null if one is unknown."""
    return (
        F.when(p0.isNull() | p1.isNull() | p2.isNull(), F.lit(None).cast("int"))
        .when((p0 >= p1) & (p0 >= p2), F.lit(0))
        .when(p1 >= p2, F.lit(1))
        .otherwise(F.lit(2))
    )


def sentiment_name(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SENTIMENTS)), index + 1)


def sentiment_index(name: Column) -> Column:
    """0, 1, 2, or null for anything outside the domain."""
    found = F.array_position(F.array(*map(F.lit, SENTIMENTS)), name).cast("int") - 1
    return F.when(found >= 0, found)


def tempered(p: Column, temperature: Column | float) -> Column:
    """exp(ln(p + tiny) / T), the numerator of a softmax over tempered log-probabilities."""
    if isinstance(temperature, Column):
        return F.pow(p + _TINY, F.lit(1.0) / temperature)
    return p + _TINY if temperature == 1.0 else F.pow(p + _TINY, F.lit(1.0 / temperature))


def entropy3(p0: Column, p1: Column, p2: Column) -> Column:
    """Entropy over ln 3, with 0 ln 0 = 0."""
    terms = [F.when(p > 0, -p * F.log(p)).otherwise(0.0) for p in (p0, p1, p2)]
    return (terms[0] + terms[1] + terms[2]) / math.log(3)


def bin_index(value: Column, bins: int, closed: str = "left") -> Column:
    """Number of the equal-width bin of [0, 1] holding the value.

    Compares with the same floating-point edges k * (1 / bins) as a linspace has, so values
    that sit on an edge fall on the right side of it. The last bin is closed on both sides.
    """
    step = 1.0 / bins
    edges = [k * step for k in range(1, bins)]
    hits = [(value >= e) if closed == "left" else (value > e) for e in edges]
    total = hits[0].cast("int")
    for h in hits[1:]:
        total = total + h.cast("int")
    return total
