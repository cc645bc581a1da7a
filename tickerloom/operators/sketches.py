"""Quantiles from stored hourly sketches: mergeable, and exact where asked for.

Each batch adds one KLL sketch per hour and group to a committed table; sketches of any hours merge into one.
A merged sketch brackets a quantile between two values. For an exact answer the rows are read once more:
values inside a bracket are counted one by one, everything between two brackets as one row. So what is ordered is
a few thousandths of the distinct values. A rank that falls outside its bracket is noticed and answered by
the exact way without sketches. Nulls are no values; NaN is left out as well, as sketches cannot hold it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.ordering import quantiles, with_running_totals
from tickerloom.params import DEFAULTS
from tickerloom.sources import commitlog

#: Size of a sketch: larger ones have narrower brackets. At most about 3 k numbers are stored per hour and group.
SIZE = 2_000
_WHOLE = "__whole"


def rank_error(size: int) -> float:
    """Normalised rank error that a sketch of this size keeps in 99 of 100 cases."""
    return 2.296 / size**0.9723


def _known(rows: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return rows.filter(v.isNotNull() & ~F.isnan(v))


def hourly_sketches(
    rows: DataFrame, value: str, by: Sequence[str] = (), ts: str = "published_at", size: int = SIZE
) -> DataFrame:
    """(bucket, by, n, low, high, sketch): one row per hour and group; partial sketches merge before the shuffle."""
    v = F.col(value).cast("double")
    return _known(rows, value).groupBy(F.date_trunc("hour", ts).alias("bucket"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.kll_sketch_agg_double(v, size).alias("sketch"),
    )


def merged(sketches: DataFrame, keys: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """Sketches merged to one row per value of the keys."""
    return sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", size).alias("sketch"),
    ).filter("n > 0")


def add_sketches(
    batch: DataFrame, path: str, batch_id: int, value: str, by: Sequence[str] = (),
    ts: str = "published_at", size: int = SIZE, compact_every: int = 16,
) -> None:
    """Commit a batch's sketches; after `compact_every` batches they become one row per hour and group."""
    spark = batch.sparkSession
    commitlog.append(hourly_sketches(batch, value, by, ts, size), path, batch_id)
    if commitlog.pending(spark, path) >= compact_every:
        commitlog.compact(spark, path, lambda rows: merged(rows, ["bucket", *by], size))
        commitlog.forget(spark, path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored rows, several per hour and group until they are merged."""
    return commitlog.read(spark, path)


def _at(rank: float) -> Column:
    """The value at a rank between 0 and 1; the ends are known exactly."""
    if rank <= 0:
        return F.col("low")
    return F.col("high") if rank >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(rank)))


def approximate_quantiles(
    sketches: DataFrame, points: dict[str, float], by: Sequence[str] = (), size: int = SIZE
) -> DataFrame:
    """Quantiles out of stored rows alone, each a value of the data within the sketch's rank error."""
    whole = merged(sketches, by, size)
    return whole.select(*by, F.col("n").alias("n_total"), *[_at(q).alias(n) for n, q in points.items()])


def _brackets(
    sketches: DataFrame, points: dict[str, float], by: Sequence[str], size: int, slack: float
) -> DataFrame:
    """One row per group: for each point an array of the least and greatest value it can have."""
    # The two ranks asked for lie up to one place away, which is nothing against the slack unless rows are few.
    few = F.col("n") * slack < 2

    def edges(q: float) -> Column:
        return F.array(
            F.when(few, F.col("low")).otherwise(_at(q - slack)), F.when(few, F.col("high")).otherwise(_at(q + slack))
        )

    # The first and last value are known without a bracket.
    inner = {n: q for n, q in points.items() if 0 < q < 1}
    return merged(sketches, by, size).select(
        *by, "low", "high", "n", *[edges(q).alias(f"__{n}") for n, q in inner.items()]
    )


def exact_quantiles(
    rows: DataFrame, sketches: DataFrame, value: str, points: dict[str, float], by: Sequence[str] = (),
    size: int = SIZE, slack: float | None = None, buckets: int = DEFAULTS.order_buckets,
) -> DataFrame:
    """Quantiles with linear interpolation of the rows that the sketches describe, equal to `quantiles`.

    One row per group, one column per point. `slack` is how far ranks are widened on both sides, three times
    the sketch's error by default. Groups that the sketches do not know give no row.
    """
    keys = list(by)
    wide = 3 * rank_error(size) if slack is None else slack
    rows = _known(rows, value).select(*keys, F.col(value).cast("double").alias(value))
    if not keys:
        rows, sketches, keys = rows.withColumn(_WHOLE, F.lit(0)), sketches.withColumn(_WHOLE, F.lit(0)), [_WHOLE]
    inner = {n: q for n, q in points.items() if 0 < q < 1}
    brackets = _brackets(sketches, points, keys, size, wide).checkpoint()

    v = F.col(value)
    shown, below = F.lit(False), F.lit(0)
    for n in inner:
        shown = shown | v.between(F.col(f"__{n}")[0], F.col(f"__{n}")[1])
        below = below + (v > F.col(f"__{n}")[1]).cast("int")
    # A row between brackets is known by how many lie below it: no value of theirs is among its own.
    placed = rows.join(brackets.drop("low", "high", "n"), keys).select(
        *keys, v, shown.alias("shown"), F.when(~shown, below).alias("gap"), F.when(shown, v).alias("own")
    )
    counted = placed.groupBy(*keys, "shown", "gap", "own").agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias(value)
    )
    # Read twice below, once for the cuts; small beside the rows.
    counted = counted.select(*keys, "shown", value, "n").checkpoint()
    ranked = with_running_totals(counted.select(*keys, value, "n"), value, ["n"], by=keys, buckets=buckets)
    ranked = ranked.join(counted.select(*keys, value, "shown"), [*keys, value])
    aggregates, missed = [], F.lit(False)
    for n, q in inner.items():
        position = (F.col("n_total") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            aggregates.append(F.max(F.when(holds, v)).alias(f"{n}__{side}"))
            missed = missed | (holds & ~F.col("shown"))
    found = ranked.groupBy(*keys).agg(
        F.max("n_total").alias("n_total"), F.max(missed).alias("missed"), *aggregates
    ).join(brackets.select(*keys, "low", "high", F.col("n").alias("known")), keys).checkpoint()
    if found.filter("missed OR n_total <> known").limit(1).count():
        exact = quantiles(rows, value, points, keys, buckets)
        return exact.join(found.select(*keys), keys, "left_semi").select(*by, *points)

    def at(name: str, q: float) -> Column:
        if q <= 0 or q >= 1:
            return F.col("low" if q <= 0 else "high").alias(name)
        position = (F.col("n_total") - 1) * F.lit(float(q))
        part = position - F.floor(position)
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        return (lo + (hi - lo) * part).alias(name)

    return found.select(*by, *[at(n, q) for n, q in points.items()])
