"""Near copies within a window, looked up in a stored index of fingerprint bands.

What is kept is stored once per band key, by day and batch. A batch bands its own fingerprints and meets
only the stored rows of days that the window reaches; nothing that is remembered is banded again. Pairs
inside the batch are found once, too. After that, deciding who is kept is joins on those small tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.fingerprint import distance
from tickerloom.operators import dedup as dd
from tickerloom.params import DEFAULTS, Params
from tickerloom.sources.tables import read_table

_BATCH = "batch_id"


def append_bands(kept: DataFrame, path: str, batch_id: int, ts: str, params: Params = DEFAULTS) -> None:
    """Store (band, band_key, fp, ts) of kept rows; a replayed batch overwrites its own days."""
    banded = dd.banded(kept.select("fp", ts), params.near_distance)
    (
        banded.select("*", F.to_date(ts).alias("day"), F.lit(batch_id).alias(_BATCH))
        .sortWithinPartitions("day", "band", "band_key")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("day", _BATCH).parquet(path)
    )


def remembered(
    prints: DataFrame, path: str, batch_id: int, since: Column, ts: str, params: Params = DEFAULTS, hot: int = 16_384
) -> DataFrame | None:
    """(fp, newest): for fingerprints of `prints`, the newest `ts` after `since` of a stored one near it.

    Where one key holds more than `hot` stored rows, pairs of those come from `near_pairs`, which cuts such
    keys a second time. Joins with banded rows are sort-merge joins by hint, as in `near_pairs`.
    """
    index = read_table(prints.sparkSession, path)
    if index is None:
        return None
    window = index.filter((F.col(_BATCH) < batch_id) & (F.col("day") >= F.to_date(since)) & (F.col(ts) > since))
    window = window.select("band", "band_key", F.col("fp").alias("seen"), F.col(ts).alias("at"))
    own = dd.banded(prints.select("fp").distinct(), params.near_distance)
    key = ["band", "band_key"]
    met = window.join(own.select(*key).hint("merge"), key, "left_semi").checkpoint()
    crowded = met.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select(*key).checkpoint()
    near = distance(F.col("fp"), F.col("seen")) <= params.near_distance
    if crowded.isEmpty():
        found = own.hint("merge").join(met, key).filter(near).select("fp", "at")
    else:
        plain = own.hint("merge").join(met.join(F.broadcast(crowded), key, "left_anti"), key).filter(near).select("fp", "at")
        dense = met.join(crowded, key, "left_semi").groupBy(F.col("seen").alias("fp")).agg(F.max("at").alias("at"))
        asking = own.join(crowded, key, "left_semi").select("fp").distinct()
        pairs = dd.near_pairs(asking, dense.select("fp"), max_distance=params.near_distance)
        found = plain.union(
            pairs.join(dense.withColumnRenamed("fp", "fp_b"), "fp_b").select(F.col("fp_a").alias("fp"), "at")
        )
    return found.groupBy("fp").agg(F.max("at").alias("newest")).checkpoint()


def keep_in_window(
    prints: DataFrame, path: str, batch_id: int, ts: str, arrival: str, params: Params = DEFAULTS
) -> DataFrame:
    """Rows of a fingerprint table (fp, arrival, ts) that no kept row blocks; they are stored under `path`.

    A kept row blocks near rows that arrive within one window after it; a blocked row prolongs nothing.
    Time is cut into slices of one window. Rows of a slice are less than a window apart, so after those that
    earlier keepers block are gone, the slice is thinned without regard to time, and only keepers of the
    slice before can block. Slices run in order, one or two in a usual batch.
    """
    window = F.make_interval(secs=F.lit(params.dedup_window_seconds))
    cut = prints.withColumn("__slice", F.floor(F.unix_micros(ts) / F.lit(params.dedup_window_seconds * 1_000_000)))
    spans = cut.groupBy("__slice").agg(F.min(ts).alias("low")).orderBy("__slice").collect()
    if not spans:
        return prints.limit(0)
    stored = remembered(prints, path, batch_id, F.lit(spans[0].low) - window, ts, params)
    pairs = dd.near_pairs(prints.select("fp").distinct(), max_distance=params.near_distance).checkpoint()
    alone = pairs.isEmpty()
    both = pairs.select("fp_a", "fp_b").union(pairs.select("fp_b", "fp_a"))
    kept: list[DataFrame] = []
    for span in spans:
        blocks = [] if stored is None else [stored]
        if kept:
            own = kept[-1].select("fp", F.col(ts).alias("newest"))
            blocks.append(own)
            if not alone:
                blocks.append(own.join(both.hint("merge"), F.col("fp") == F.col("fp_a")).select(F.col("fp_b").alias("fp"), "newest"))
        left = cut.filter(F.col("__slice") == span["__slice"]).drop("__slice")
        if blocks:
            until = reduce(DataFrame.union, blocks).groupBy("fp").agg(F.max("newest").alias("__newest"))
            free = F.col("__newest").isNull() | (F.col(ts) >= F.col("__newest") + window)
            left = left.join(until.hint("merge"), "fp", "left").filter(free).drop("__newest")
        first = dd.dedup_exact(left, "fp", arrival).select(*prints.columns)
        if not alone:
            first = first.checkpoint()
            dropped = dd.dropped_fingerprints(first.select("fp", arrival), params, arrival, pairs)
            first = first.join(dropped.hint("merge"), "fp", "left_anti")
        kept.append(first.select(*prints.columns).checkpoint())
    out = reduce(DataFrame.unionByName, kept)
    append_bands(out, path, batch_id, ts, params)
    return out
