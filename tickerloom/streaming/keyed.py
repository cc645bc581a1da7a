"""Stateful streams by key: a value per key in the RocksDB store, dropped by event-time timers.

Both hold small rows only (a key, a time, a class), never texts. A key's rows of one micro-batch are
ordered in the task that owns the key; how many that are is bounded by the size of a micro-batch. Rows
later than the watermark allows are dropped by Spark, so `late` must cover the disorder of the source.
Equal times are no disorder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickerloom.params import DEFAULTS, Params
from tickerloom.session import prepare

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> SparkSession:
    """State with timers needs this store; it also keeps state out of the JVM's heap."""
    prepare(spark).conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    return spark


def _micros(times: pd.Series) -> np.ndarray:
    if times.dt.tz is not None:
        times = times.dt.tz_convert("UTC").dt.tz_localize(None)
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


class _Timer:
    """One event-time timer per key, moved along with the state that it ends."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle

    @staticmethod
    def at(micros: int) -> int:
        return -(-micros // 1000)

    def move(self, old: int | None, new: int) -> None:
        if old is not None:
            self.handle.deleteTimer(self.at(old))
        self.handle.registerTimer(self.at(new))


# --- exact copies within a window -------------------------------------------------------------------------


class _Remember(StatefulProcessor):
    """The time until which a hash is blocked. Rows, not data frames: most hashes have one row in a batch."""

    def __init__(self, window: int, arrival: str):
        self.window, self.arrival = window, arrival

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.until = handle.getValueState("until", "at long")
        self.timer = _Timer(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.until.get()
        held = until = None if held is None else held[0]
        for row in sorted(rows, key=lambda r: (r["at"], r[self.arrival])):
            if until is None or row["at"] >= until:
                until = row["at"] + self.window
                yield Row(content_hash=key[0], **{self.arrival: row[self.arrival], "at": row["at"]})
        if until != held:
            self.until.update((until,))
            self.timer.move(held, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_in_window(
    articles: DataFrame, ts: str = "ingest_ts", arrival: str = "ordinal", params: Params = DEFAULTS,
    late: str = "10 minutes",
) -> DataFrame:
    """Stream of (content_hash, arrival, ts): the rows that no kept row of their hash blocks.

    A kept row blocks its copies for one window from its own time; copies prolong nothing. State is one
    number per hash kept within the last window. `arrival` is a number that settles equal times.
    """
    keep_state_in_rocksdb(articles.sparkSession)
    rows = articles.withWatermark(ts, late).select("content_hash", F.col(arrival).cast("long").alias(arrival), ts, F.unix_micros(ts).alias("at"))
    kept = rows.groupBy("content_hash").transformWithState(
        _Remember(params.dedup_window_seconds * 1_000_000, arrival), f"content_hash string, {arrival} long, at long", "append", "eventTime"
    )
    return kept.select("content_hash", arrival, F.timestamp_micros("at").alias(ts))


# --- ticker records with a time to live ----------------------------------------------------------------------

_CLASSES = ("positive", "negative", "neutral")
_RECORD = "article_count long, positive_count long, negative_count long, neutral_count long, updated_at timestamp"
_COLUMNS = ["ticker", *[c.split()[0] for c in _RECORD.split(", ")], "expired"]


class _TickerRecord(StatefulProcessor):
    """Counts of a ticker since it was last silent for longer than the time to live."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", "n long, positive long, negative long, neutral long, at long")
        self.timer = _Timer(handle)

    def _row(self, key, record, expired: bool) -> pd.DataFrame:
        *counts, at = record
        return pd.DataFrame([[key[0], *counts, pd.Timestamp(at, unit="us"), expired]], columns=_COLUMNS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        at = _micros(batch["published_at"])
        order = np.argsort(at, kind="stable")
        at, names = at[order], batch["ensemble_sentiment"].to_numpy()[order]
        held = self.record.get() if self.record.exists() else None
        # What came before the last long silence has expired.
        cuts = np.flatnonzero(np.diff(at) > self.ttl) + 1
        first = int(cuts[-1]) if len(cuts) else 0
        goes_on = held is not None and first == 0 and at[0] - held[4] <= self.ttl
        before = held[:4] if goes_on else (0, 0, 0, 0)
        names = names[first:]
        counts = [len(names), *[int((names == c).sum()) for c in _CLASSES]]
        newest = int(at[-1]) if held is None else max(int(at[-1]), held[4])
        record = (*[a + b for a, b in zip(before, counts)], newest)
        self.record.update(record)
        self.timer.move(None if held is None else held[4] + self.ttl, newest + self.ttl)
        yield self._row(key, record, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        record = self.record.get()
        self.record.clear()
        yield self._row(key, record, True)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        at = int(_micros(initialState["updated_at"])[0])
        self.record.update((*[int(row[f"{c}_count"]) for c in ("article", *_CLASSES)], at))
        self.timer.move(None, at + self.ttl)

    def close(self) -> None:
        pass


def ticker_sessions(results: DataFrame, ttl_seconds: int) -> DataFrame:
    """The record of every ticker after all rows: counts since its last silence beyond the time to live.

    Session windows merge within each task before the shuffle.
    """
    gap = f"{ttl_seconds} seconds 1 microsecond"
    mentions = results.select(F.explode("tickers").alias("ticker"), "ensemble_sentiment", "published_at")
    sessions = mentions.groupBy("ticker", F.session_window("published_at", gap)).agg(
        F.count(F.lit(1)).alias("article_count"),
        *[F.count_if(F.col("ensemble_sentiment") == c).alias(f"{c}_count") for c in _CLASSES],
        F.max("published_at").alias("updated_at"),
    )
    last = sessions.drop("session_window").groupBy("ticker").agg(
        F.max(F.struct("updated_at", "article_count", *[f"{c}_count" for c in _CLASSES])).alias("r")
    )
    return last.select("ticker", *[f"r.{c}" for c in _COLUMNS[1:-1]])


def ticker_records(
    results: DataFrame, ttl_seconds: int = DEFAULTS.ticker_ttl_seconds, initial: DataFrame | None = None,
    late: str = "10 minutes",
) -> DataFrame:
    """Stream of a ticker's record after each micro-batch that mentions it, and once more, `expired`, when
    event time has passed its last mention by the time to live.

    `initial`, a stored table as `ticker_sessions` gives it, is what the state begins with.
    """
    keep_state_in_rocksdb(results.sparkSession)
    mentions = results.withWatermark("published_at", late).select(
        F.explode("tickers").alias("ticker"), "ensemble_sentiment", "published_at"
    )
    start = None if initial is None else initial.groupBy("ticker")
    return mentions.groupBy("ticker").transformWithStateInPandas(
        _TickerRecord(ttl_seconds * 1_000_000), f"ticker string, {_RECORD}, expired boolean", "update", "eventTime", start
    )


def alive_records(changes: DataFrame, now, ttl_seconds: int, version: str = "batch_id") -> DataFrame:
    """The newest record of each ticker in a table of changes, if it has not expired by `now`."""
    newest = changes.groupBy("ticker").agg(F.max_by(F.struct(*_COLUMNS[1:]), version).alias("r"))
    records = newest.select("ticker", "r.*").filter("NOT expired").drop("expired")
    return records.filter(F.col("updated_at") >= now - F.make_interval(secs=F.lit(ttl_seconds)))
