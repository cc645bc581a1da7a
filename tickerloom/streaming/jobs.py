"""Structured Streaming jobs: enrichment, hourly rollup, de-duplication, ticker state.

Every sink below is safe to repeat with the same batch: inserts are anti-joined against what is
stored, and keyed tables are written under the batch number, so a replayed batch overwrites its
own output. Offsets are committed by the checkpoint after the sink returns: delivery is at least
once and the effect is exactly once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tickerloom.functions.fingerprint import simhash64
from tickerloom.operators import dedup as dd
from tickerloom.operators.results import assemble_results, latest_cache
from tickerloom.operators.rollups import (
    AVERAGES,
    ROLLUP_KEYS,
    hourly_partials,
    merge_partials,
    ticker_aggregates,
)
from tickerloom.operators.scoring import predict
from tickerloom.params import DEFAULTS, Params
from tickerloom.session import prepare, spread
from tickerloom.sources import commitlog
from tickerloom.sources.tables import absent_only, append_by_date, read_table
from tickerloom.sources.topic import dead_letters, decode, decoded_articles, status
from tickerloom.streaming.bands import keep_in_window
from tickerloom.streaming.keyed import first_in_window, ticker_records

# Articles of a batch to (score table, pass table).
Scorer = Callable[[DataFrame], tuple[DataFrame, DataFrame]]

_BATCH = "batch_id"


def start(
    writer: DataStreamWriter, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start with a checkpoint: run what is available and stop, or keep a micro-batch interval."""
    placed = writer.option("checkpointLocation", checkpoint)
    timed = placed.trigger(processingTime=every) if every else placed.trigger(availableNow=True)
    return timed.start()


def _batch_path(path: str, batch_id: int) -> str:
    return f"{path}/{_BATCH}={batch_id}"


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(_batch_path(path, batch_id))


# --- enrichment ------------------------------------------------------------------------------------


def enrich_stream(
    messages: DataFrame,
    scorer: Scorer,
    path: str,
    params: Params = DEFAULTS,
    processed_at: Column | None = None,
) -> DataStreamWriter:
    """Messages to results: `path/results` by date, and `path/dead` per batch.

    Counters by decode status travel as an observed metric named `consumed`.
    """
    decoded = decode(messages)
    own = status()
    counted = decoded.observe(
        "consumed",
        *[F.count_if(own == s).alias(s) for s in ("ok", "deserialise_error")],
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Both are read several times below: hold them for the length of this call.
        batch = spread(batch).persist()
        table = read_table(batch.sparkSession, f"{path}/results")
        fresh = absent_only(decoded_articles(batch), table, "content_hash").persist()
        try:
            # Only articles not stored yet reach the models.
            scores, passes = scorer(fresh)
            enriched = assemble_results(
                fresh, predict(scores, passes, params), params, processed_at=processed_at
            )
            append_by_date(enriched, f"{path}/results")
            _write_batch(dead_letters(batch), f"{path}/dead", batch_id)
        finally:
            fresh.unpersist()
            batch.unpersist()

    return counted.writeStream.foreachBatch(handle)


def publish_stream(results: DataFrame, path: str) -> DataStreamWriter:
    """Each result as a JSON message for subscribers, appended to a folder of text files."""
    wire = results.select(F.to_json(F.struct(*[F.col(c) for c in results.columns])).alias("value"))
    return wire.writeStream.format("text").option("path", path).outputMode("append")


def latest_stream(results: DataFrame, path: str, params: Params = DEFAULTS) -> DataStreamWriter:
    """Keep the newest `latest_cap` results: old cache and batch are bounded top-n inputs.

    Rows older than the cache's time to live before the newest row expire on read.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        before = _version(batch.sparkSession, path, batch_id - 1)
        merged = batch if before is None else before.select(*batch.columns).unionByName(batch)
        _write_batch(latest_cache(merged.dropDuplicates(["article_hash"]), params), path, batch_id)

    return results.writeStream.foreachBatch(handle)


def unexpired(cache: DataFrame, now: datetime | Column, ttl_seconds: int, column: str) -> DataFrame:
    return cache.filter(F.col(column) >= F.lit(now) - F.make_interval(secs=F.lit(ttl_seconds)))


def _version(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """A keyed table as one batch left it. Batch numbers have no gaps; the first has none before."""
    return read_table(spark, _batch_path(path, batch_id))


def read_latest(spark: SparkSession, path: str) -> DataFrame | None:
    """A keyed table as the newest batch left it; older versions may be removed at any time."""
    table = read_table(spark, path)
    if table is None:
        return None
    newest = table.agg(F.max(_BATCH)).first()[0]
    return None if newest is None else _version(spark, path, newest)


# --- hourly rollup -----------------------------------------------------------------------------------


_SUMS = ("article_count", *[n.replace("avg_", "sum_") for n in AVERAGES])


def hourly_stream(
    results: DataFrame, path: str, late: str = "2 hours", compact_every: int = 16
) -> DataStreamWriter:
    """Tumbling hourly counts and sums; each batch commits the groups it changed.

    After every `compact_every` batches they are merged into a new base of one row per group, so a
    reader meets the base and fewer than that many changes, however long the stream has run.
    """
    bucket = F.window("published_at", "1 hour").getField("start")
    summed = hourly_partials(results.withWatermark("published_at", late), bucket)

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        commitlog.append(batch.withColumn(_BATCH, F.lit(batch_id)), path, batch_id)
        if commitlog.pending(spark, path) >= compact_every:
            compact_hourly(spark, path)

    return summed.writeStream.outputMode("update").foreachBatch(handle)


def _newest_state(log: DataFrame) -> DataFrame:
    newest = log.groupBy(*ROLLUP_KEYS).agg(F.max(F.struct(_BATCH, *_SUMS)).alias("state"))
    return newest.select(*ROLLUP_KEYS, *[f"state.{c}" for c in (_BATCH, *_SUMS)])


def compact_hourly(spark: SparkSession, path: str) -> None:
    commitlog.compact(spark, path, _newest_state)
    commitlog.forget(spark, path)


def read_hourly(spark: SparkSession, path: str) -> DataFrame:
    """The rollup: the newest state of every group in the base and the batches after it."""
    return merge_partials(_newest_state(commitlog.read(spark, path)).drop(_BATCH))


# --- de-duplication ------------------------------------------------------------------------------------


def dedup_exact_stream(
    articles: DataFrame, path: str, ts: str = "ingest_ts", arrival: str = "ordinal",
    params: Params = DEFAULTS,
) -> DataStreamWriter:
    """First arrival per hash; a hash is remembered for the window, not refreshed by copies.

    `path/kept` holds hash, arrival and time of what was kept. The window is measured between the rows'
    own times; what is remembered is keyed state, so a batch costs one pass over its own rows.
    """
    kept = first_in_window(articles, ts, arrival, params)

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, f"{path}/kept", batch_id)

    return kept.writeStream.outputMode("append").foreachBatch(handle)


def dedup_near_stream(
    articles: DataFrame, path: str, ts: str = "ingest_ts", arrival: str = "ordinal",
    params: Params = DEFAULTS,
) -> DataStreamWriter:
    """Exact and near de-duplication against what was kept in the window.

    `path/bands` holds the bands of kept fingerprints by day and batch, so the window prunes days and old
    days may be removed; `path/kept` holds the articles. Equal hashes mean equal headlines, so the
    fingerprint, computed once per hash, decides exact copies too.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        prepare(batch.sparkSession)
        batch = spread(batch)
        by_hash = dd.dedup_exact(batch, arrival=arrival).select(
            "content_hash", simhash64(F.col("headline")).alias("fp")
        )
        prints = batch.select("content_hash", arrival, ts).join(by_hash, "content_hash").checkpoint()
        kept = keep_in_window(prints.drop("content_hash"), f"{path}/bands", batch_id, ts, arrival, params)
        _write_batch(batch.join(kept.select(arrival), arrival, "left_semi"), f"{path}/kept", batch_id)

    return articles.writeStream.foreachBatch(handle)


# --- ticker state ------------------------------------------------------------------------------------


def ticker_state_stream(
    results: DataFrame, path: str, now: Column | None = None, params: Params = DEFAULTS
) -> DataStreamWriter:
    """Per ticker: shares and averages of its last batch, and a count over unexpired state.

    A batch is reduced to one row per ticker, with map-side combining, before it meets the
    state, so a ticker with a third of all mentions is one row there. The state has one row per
    ticker seen within the time to live; tickers are 2 to 5 capitals, which bounds it.
    """
    clock = now if now is not None else F.current_timestamp()

    def handle(batch: DataFrame, batch_id: int) -> None:
        changed = ticker_changes(batch).withColumn("updated_at", clock)
        before = _version(batch.sparkSession, path, batch_id - 1)
        if before is not None:
            changed = merge_ticker_state(before, changed, clock, params.ticker_ttl_seconds)
        _write_batch(changed, path, batch_id)

    return results.writeStream.foreachBatch(handle)


def ticker_record_stream(
    results: DataFrame, path: str, ttl_seconds: int = DEFAULTS.ticker_ttl_seconds, initial: DataFrame | None = None
) -> DataStreamWriter:
    """Records of tickers with a time to live in event time; each batch stores those that it changed."""
    changed = ticker_records(results, ttl_seconds, initial)

    def handle(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch, path, batch_id)

    return changed.writeStream.outputMode("update").foreachBatch(handle)


def ticker_changes(batch: DataFrame) -> DataFrame:
    """The batch's own aggregates with the sums that cumulative shares need."""
    sums = (
        batch.select(F.explode("tickers").alias("ticker"), "ensemble_sentiment")
        .groupBy("ticker")
        .agg(
            *[
                F.count_if(F.col("ensemble_sentiment") == s).alias(f"{s}_count")
                for s in ("positive", "negative", "neutral")
            ]
        )
    )
    return ticker_aggregates(batch).join(sums, "ticker")


_ADDED = ("article_count", "positive_count", "negative_count", "neutral_count")


def merge_ticker_state(
    before: DataFrame, changed: DataFrame, now: Column, ttl_seconds: int
) -> DataFrame:
    """Unexpired old state and a batch's changes; counts add up, shares are the batch's."""
    alive = unexpired(before, now, ttl_seconds, "updated_at")
    columns = changed.columns
    old = alive.select("ticker", *[F.col(c).alias(f"old_{c}") for c in columns if c != "ticker"])
    joined = changed.join(old, "ticker", "full")
    merged = [
        (F.coalesce(F.col(c), F.lit(0)) + F.coalesce(F.col(f"old_{c}"), F.lit(0))).alias(c)
        if c in _ADDED
        else F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c)
        for c in columns
        if c != "ticker"
    ]
    return joined.select("ticker", *merged)
