"""Inverted lists of tickers: who reads one ticker reads that ticker's files.

A posting is one article under one of its tickers, with the columns that summaries need. Postings lie in slots by the
ticker's hash and in days, sorted by ticker and time, so a lookup opens one slot of the days of its window and
skips row groups of other tickers. A ticker with a third of all rows is cut into files of the usual size when written.
Batches are committed as in `commitlog`.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators.results import newest, since
from tickerloom.params import DEFAULTS, Params
from tickerloom.sources import commitlog

SLOTS = 64
_PLACE = ("slot", "published_date")
_COLUMNS = (
    "ticker string, article_hash string, published_at timestamp, ensemble_sentiment string, "
    "ensemble_confidence double, ensemble_uncertainty double, slot int, published_date date"
)


def _slot(ticker: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(slots)).cast("int")


def postings(results: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One row per article and distinct ticker; articles without tickers have none."""
    listed = results.select(
        F.explode(F.array_distinct("tickers")).alias("ticker"), "article_hash", "published_at",
        "ensemble_sentiment", "ensemble_confidence", "ensemble_uncertainty",
    )
    return listed.withColumns(
        {"slot": _slot(F.col("ticker"), slots), "published_date": F.to_date("published_at")}
    )


def _laid_out(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", *_PLACE).sortWithinPartitions(*_PLACE, "ticker", "published_at")


def add_postings(
    results: DataFrame, path: str, batch_id: int, slots: int = SLOTS, compact_every: int = 16
) -> bool:
    """Commit a batch's postings, each batch once; small files are merged after `compact_every` batches."""
    spark = results.sparkSession
    added = commitlog.append(_laid_out(postings(results, slots)), path, batch_id, _PLACE)
    if commitlog.pending(spark, path) >= compact_every:
        commitlog.compact(spark, path, _laid_out, _PLACE, read_postings(spark, path))
        commitlog.forget(spark, path)
    return added


def read_postings(spark: SparkSession, path: str) -> DataFrame | None:
    """All postings; the base and fewer than `compact_every` batches are read."""
    parts = [spark.read.schema(_COLUMNS).parquet(f) for f in commitlog.folders(spark, path)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def of_ticker(stored: DataFrame, ticker: str, slots: int = SLOTS) -> DataFrame:
    """A ticker's postings in the form of results: `tickers` holds this one."""
    wanted = ticker.upper()
    slot = stored.sparkSession.range(1).select(_slot(F.lit(wanted), slots)).first()[0]
    found = stored.filter((F.col("slot") == slot) & (F.col("ticker") == wanted))
    return found.withColumn("tickers", F.array("ticker"))


def by_ticker(
    stored: DataFrame, results: DataFrame, ticker: str, as_of: datetime | Column, hours: int = 24,
    params: Params = DEFAULTS, slots: int = SLOTS,
) -> DataFrame:
    """The newest rows that name the ticker: chosen from postings, then fetched from their days of the table."""
    chosen = newest(since(of_ticker(stored, ticker, slots), as_of, hours), params.ticker_row_cap)
    keys = chosen.select("published_date", "article_hash")
    return results.join(keys, keys.columns, "left_semi")
