"""Exact order statistics without a one-partition window.

Running totals over a globally ordered table are taken in two levels. The table is cut at
approximate quantiles of its own distinct values into buckets of about equal size, whatever the
distribution; bucket totals (a table of bounded size) give each bucket its starting total, and a
window inside each bucket does the rest. The cut is approximate, the totals are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.params import DEFAULTS

_BUCKET = "__bucket"


def _with_bucket(rows: DataFrame, order: str, steps: int) -> DataFrame:
    """Add the number of cuts at or below the value: a binary search in chained projections.

    The cuts come from a first pass, as the bounds of a range partitioning do: at most `steps`
    numbers reach the driver and go into the plan as one constant. The search costs log2(steps)
    comparisons inside generated code.
    """
    text = ",".join(repr(i / steps) for i in range(1, steps))
    fractions = F.split(F.lit(text), ",").cast("array<double>")
    found = rows.agg(F.percentile_approx(order, fractions, steps * 4).alias("cuts")).first()
    kind = rows.schema[order].dataType.simpleString()
    cuts = F.split(F.lit(",".join(map(repr, found["cuts"] or []))), ",").cast(f"array<{kind}>")
    found = rows.withColumn(_BUCKET, F.lit(0))
    half = steps // 2
    while half:
        at_or_below = F.get(cuts, F.col(_BUCKET) + (half - 1)) <= F.col(order)
        found = found.withColumn(
            _BUCKET, F.col(_BUCKET) + F.when(at_or_below, half).otherwise(0)
        )
        half //= 2
    return found


def with_running_totals(
    distinct_rows: DataFrame,
    order: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    buckets: int = DEFAULTS.order_buckets,
) -> DataFrame:
    """Add `<m>_before` (total of m over earlier rows) and `<m>_total` (over all), per `by` group.

    `distinct_rows` holds one row per (`by`, `order`) value, so no value can fill a bucket by
    being frequent. `by` must have few values (classes): the bucket table that is broadcast has
    at most buckets x groups rows.
    """
    binned = _with_bucket(distinct_rows, order, 1 << (buckets - 1).bit_length())

    def ordered(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    whole = Window.partitionBy(*by)
    earlier_buckets = whole.orderBy(ordered(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(*by, _BUCKET)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *by,
            _BUCKET,
            *[F.coalesce(F.sum(m).over(earlier_buckets), F.lit(0)).alias(f"{m}_offset")
              for m in measures],
            *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
        )
    )
    in_bucket = (
        Window.partitionBy(*by, _BUCKET)
        .orderBy(ordered(order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = binned.select(
        "*",
        *[F.coalesce(F.sum(m).over(in_bucket), F.lit(0)).alias(f"{m}_inner") for m in measures],
    )
    return running.join(F.broadcast(offsets), [*by, _BUCKET]).select(
        *distinct_rows.columns,
        *[(F.col(f"{m}_offset") + F.col(f"{m}_inner")).alias(f"{m}_before") for m in measures],
        *[f"{m}_total" for m in measures],
    )


def quantiles(
    df: DataFrame,
    value: str,
    points: dict[str, float],
    by: Sequence[str] = (),
    buckets: int = DEFAULTS.order_buckets,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per point."""
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    )
    ranked = with_running_totals(counted, value, ["n"], by=by, buckets=buckets)
    lower, upper = {}, {}
    for name, q in points.items():
        position = (F.col("n_total") - 1) * F.lit(float(q))
        for side, rank in ((lower, F.floor(position)), (upper, F.ceil(position))):
            holds = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
            side[name] = F.max(F.when(holds, F.col(value).cast("double")))
    found = ranked.groupBy(*by).agg(
        F.max("n_total").alias("n_total"),
        *[c.alias(f"{n}__lo") for n, c in lower.items()],
        *[c.alias(f"{n}__hi") for n, c in upper.items()],
    )

    def interpolated(name: str, q: float) -> Column:
        position = (F.col("n_total") - 1) * F.lit(float(q))
        part = position - F.floor(position)
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        return (lo + (hi - lo) * part).alias(name)

    return found.select(*by, *[interpolated(n, q) for n, q in points.items()])


def value_at_rank(
    df: DataFrame, value: str, rank: Column, descending: bool, buckets: int = DEFAULTS.order_buckets
) -> DataFrame:
    """One row: the value that holds a zero-based rank, and how many rows come before it."""
    counted = df.groupBy(value).agg(F.count("*").alias("n"))
    ranked = with_running_totals(counted, value, ["n"], descending=descending, buckets=buckets)
    return ranked.filter(
        (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
    ).select(F.col(value).alias("value"), F.col("n_before").alias("before"))
