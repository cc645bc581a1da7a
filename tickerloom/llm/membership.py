"""A fixed-size bitmap of keys, to leave rows out of a shuffle that cannot find a partner in it.

Keys set bits of a table with at most 2^17 rows of 64 bits. Its size has that bound whatever the
data, so it may be broadcast. A key that is in the set is always found; others pass by chance, the
oftener the fuller the bitmap, so an exact step must follow. A full bitmap saves nothing and loses
nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 1 << 17


def fresh(name: str, *tables: DataFrame) -> str:
    """A working column's name that no column of the tables has, in either case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _place(key: Column) -> tuple[Column, Column]:
    spread = F.xxhash64(key, F.lit(17))
    slot = F.shiftrightunsigned(spread, 47).cast("int")
    bit = spread.bitwiseAND(F.lit(63)).cast("int")
    return slot, bit


def bitmap(keys: DataFrame, key: Column) -> DataFrame:
    """(slot, mask) with at most ROWS rows."""
    slot, bit = _place(key)
    return keys.select(
        slot.alias("__slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m")
    ).groupBy("__slot").agg(F.bit_or("m").alias("__mask"))


def maybe_members(df: DataFrame, key: Column, bits: DataFrame, absent: bool = False) -> DataFrame:
    """Rows whose key may be in the set; with `absent`, those whose key surely is not."""
    slot, bit = _place(key)
    at, place, row, mask = (fresh(n, df) for n in ("__at", "__bit", "__row", "__mask"))
    table = bits.select(F.col("__slot").alias(row), F.col("__mask").alias(mask))
    joined = df.withColumns({at: slot, place: bit}).join(F.broadcast(table), F.col(at) == F.col(row), "left")
    shifted = F.call_function("shiftrightunsigned", F.col(mask), F.col(place))
    inside = F.coalesce(shifted.bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.filter(~inside if absent else inside).drop(at, place, row, mask)


#: The bitmap that numpy code reads has 2^25 bits, 4 MB. More keys call for more.
ARRAY_BITS = 25


def bit_array(keys: DataFrame, name: str, bits: int = ARRAY_BITS) -> np.ndarray:
    """The same for code that looks keys up in arrays: 2^bits bits, read by `in_bits`.

    Keys are longs whose low bits are spread evenly. The driver receives at most 2^(bits - 6) rows of eight bytes, whatever the number of keys.
    """
    place = F.col(name).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    words = keys.select(
        F.shiftright(place, 6).cast("int").alias("w"),
        F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("m"),
    ).groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_bits(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.uint64(64 * len(table) - 1)
    return (table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
