"""Drift from stored hourly profiles instead of rows.

A profile is a histogram of confidences, counts of classes and sums of probabilities. Profiles of hours add up
to that of a window, and a moving window takes in one hour and lets go of another. A window that begins within an hour
is exact too: the rows of that one hour are read, and no others.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerloom.functions.probability import bin_index
from tickerloom.functions.vocab import SENTIMENTS
from tickerloom.operators import drift
from tickerloom.params import DEFAULTS, Params
from tickerloom.sources import commitlog

_PROBS = ("positive_prob", "negative_prob", "neutral_prob")


def measures(params: Params = DEFAULTS) -> list[str]:
    """Columns of a profile; all of them add up."""
    return [
        "n", *[f"bin_{b}" for b in range(params.psi_bins)], *[f"label_{k}" for k in range(len(SENTIMENTS))],
        *[f"prob_{k}" for k in range(len(_PROBS))], *[f"known_{k}" for k in range(len(_PROBS))],
    ]


def _aggregates(params: Params) -> list[Column]:
    x = F.col("ensemble_confidence")
    bin_no = F.when((x >= 0) & (x <= 1), bin_index(x, params.psi_bins))
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(bin_no == b).alias(f"bin_{b}") for b in range(params.psi_bins)],
        *[F.count_if(F.col("ensemble_sentiment") == s).alias(f"label_{k}") for k, s in enumerate(SENTIMENTS)],
        *[F.coalesce(F.sum(p), F.lit(0.0)).alias(f"prob_{k}") for k, p in enumerate(_PROBS)],
        *[F.count(p).alias(f"known_{k}") for k, p in enumerate(_PROBS)],
    ]


def hourly_profiles(results: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """(bucket, measures): one row per hour."""
    return results.groupBy(F.date_trunc("hour", "published_at").alias("bucket")).agg(*_aggregates(params))


def _added(profiles: DataFrame, params: Params, *keys: str) -> DataFrame:
    return profiles.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures(params)])


def add_profiles(
    batch: DataFrame, path: str, batch_id: int, params: Params = DEFAULTS, compact_every: int = 16
) -> None:
    """Commit a batch's profiles; after `compact_every` batches they become one row per hour."""
    spark = batch.sparkSession
    commitlog.append(hourly_profiles(batch, params), path, batch_id)
    if commitlog.pending(spark, path) >= compact_every:
        commitlog.compact(spark, path, lambda rows: _added(rows, params, "bucket"))
        commitlog.forget(spark, path)


def read_profiles(spark: SparkSession, path: str, params: Params = DEFAULTS) -> DataFrame | None:
    """One row per hour."""
    stored = commitlog.read(spark, path)
    return None if stored is None else _added(stored, params, "bucket")


def window_profile(
    profiles: DataFrame, results: DataFrame, as_of: datetime | Column, hours: int, params: Params = DEFAULTS
) -> DataFrame:
    """One row: the profile of the rows at or after `as_of` less some hours, as `results.since` finds them."""
    cutoff = F.lit(as_of) - F.make_interval(hours=F.lit(hours))
    started = F.date_trunc("hour", cutoff)
    first_whole = F.when(started == cutoff, started).otherwise(started + F.make_interval(hours=F.lit(1)))
    part = results.filter((F.col("published_at") >= cutoff) & (F.col("published_at") < first_whole))
    if "published_date" in results.columns:
        part = part.filter(F.col("published_date") == F.to_date(cutoff))
    whole = profiles.filter(F.col("bucket") >= first_whole).select(*measures(params))
    both = whole.unionByName(part.agg(*_aggregates(params)))
    return both.agg(*[F.sum(m).alias(m) for m in measures(params)])


def _side(profile: DataFrame, side: str, params: Params, *keys: str) -> DataFrame:
    """A profile under the column names of one side of a drift report."""
    kept = [m for m in measures(params) if not m.startswith(("prob_", "known_"))]
    means = [
        F.try_divide(F.col(f"prob_{k}"), F.col(f"known_{k}")).alias(f"{side}_prob_{k}") for k in range(len(_PROBS))
    ]
    return profile.select(*keys, *[F.col(m).alias(f"{side}_{m}") for m in kept], *means)


def _thick(report: DataFrame, min_reference: int, min_current: int) -> DataFrame:
    return report.filter(
        (F.col("reference_rows") >= min_reference) & (F.col("current_rows") >= min_current)
    )


def drift_check(
    profiles: DataFrame, results: DataFrame, as_of: datetime | Column, lookback_hours: int = 1,
    reference_hours: int = 24, params: Params = DEFAULTS, min_reference: int = 50, min_current: int = 10,
) -> DataFrame:
    """The row of `drift.drift_check`, from `reference_hours` + 1 stored rows and the rows of two broken hours."""
    one = F.lit(0).alias("one")
    current = _side(window_profile(profiles, results, as_of, lookback_hours, params), "cur", params)
    reference = _side(window_profile(profiles, results, as_of, reference_hours, params), "ref", params)
    both = reference.select(one, "*").join(current.select(one, "*"), "one")
    checked_at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return _thick(drift.report_of(both, params, checked_at), min_reference, min_current)


def moving_profiles(profiles: DataFrame, hours: int, params: Params = DEFAULTS) -> DataFrame:
    """At the end of each hour that has rows, the profile of so many hours back.

    Counts are differences of running totals: one hour in, one out. Sums of probabilities are added anew, so that no
    rounding is carried along. The ordered table has one row per hour, whatever the rows.
    """
    span = hours * 3_600
    at = F.unix_timestamp("bucket")
    everything = Window.partitionBy().orderBy(at)
    running = everything.rowsBetween(Window.unboundedPreceding, 0)
    inside = everything.rangeBetween(-span + 1, 0)
    before = everything.rangeBetween(Window.unboundedPreceding, -span)
    moved = [
        F.sum(m).over(inside).alias(m) if m.startswith("prob_")
        else (F.sum(m).over(running) - F.coalesce(F.max(F.col(f"{m}__t")).over(before), F.lit(0))).alias(m)
        for m in measures(params)
    ]
    totals = profiles.select(
        "bucket", *measures(params),
        *[F.sum(m).over(running).alias(f"{m}__t") for m in measures(params) if not m.startswith("prob_")],
    )
    return totals.select("bucket", *moved)


def drift_hourly(
    profiles: DataFrame, lookback_hours: int = 1, reference_hours: int = 24, params: Params = DEFAULTS,
    min_reference: int = 50, min_current: int = 10,
) -> DataFrame:
    """The drift check at the end of every hour, from profiles alone; `timestamp` is that end.

    Rows at the very end belong to the next hour: windows are half-open here.
    """
    current = _side(moving_profiles(profiles, lookback_hours, params), "cur", params, "bucket")
    reference = _side(moving_profiles(profiles, reference_hours, params), "ref", params, "bucket")
    end = F.col("bucket") + F.make_interval(hours=F.lit(1))
    return _thick(drift.report_of(reference.join(current, "bucket"), params, end), min_reference, min_current)
