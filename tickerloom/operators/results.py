"""Assembling result rows and asking the result table for them."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.probability import rounded
from tickerloom.functions.text import with_features
from tickerloom.functions.vocab import IMPACTS, SENTIMENTS
from tickerloom.operators.models import EntityFn, ImpactFn, with_entities, with_impact_fallback
from tickerloom.params import DEFAULTS, Params
from tickerloom.schemas import SENTIMENT_RESULT, conform

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
WINDOW_HOURS = {"1h": 1, "6h": 6, "24h": 24, "48h": 48, "7d": 168}


def iso(ts: Column) -> Column:
    return F.date_format(ts, _ISO)


def between(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in {low}..{high}, got {value}")
    return value


# --- assembling --------------------------------------------------------------------------------


def assemble_results(
    articles: DataFrame,
    predictions: DataFrame,
    params: Params = DEFAULTS,
    entity_fn: EntityFn | None = None,
    impact_fn: ImpactFn | None = None,
    processed_at: Column | None = None,
) -> DataFrame:
    """Articles joined to their predictions by hash, with every text feature.

    A task holds its predictions, one narrow row per hash, in a hash table, and whole texts stream past
    them. A sort-merge join sorts the texts as well, and spills them where a task's memory is short.
    """
    keyed = articles.withColumnRenamed("content_hash", "article_hash")
    asked = with_impact_fallback(with_entities(keyed, entity_fn, params), impact_fn)
    featured = with_features(asked, "fallback_impact").drop("fallback_impact", "body", "author")
    joined = featured.join(predictions.hint("shuffle_hash"), "article_hash").withColumn(
        "processed_at", processed_at if processed_at is not None else F.current_timestamp()
    )
    return conform(joined.withColumn("temperature_scaled", F.lit(True)), SENTIMENT_RESULT)


# --- wire forms --------------------------------------------------------------------------------

_ROUNDED = (
    "ensemble_confidence", "ensemble_uncertainty", "positive_prob", "negative_prob",
    "neutral_prob", "hedge_score",
)


def article_dict(articles: DataFrame) -> DataFrame:
    return articles.select(
        "source", "headline", "url", iso(F.col("published_at")).alias("published_at"), "body",
        "author", "content_hash",
    )


def result_dict(results: DataFrame) -> DataFrame:
    return results.select(
        "article_hash", "headline", "url", "source",
        iso(F.col("published_at")).alias("published_at"),
        iso(F.col("processed_at")).alias("processed_at"),
        "ensemble_sentiment",
        *[rounded(F.col(c), 4).alias(c) for c in _ROUNDED],
        "tickers", "sectors", "is_forward_looking", "has_negation", "market_impact",
        "is_uncertain",
        F.size("model_predictions").alias("model_count"),
    )


# --- predicates and bounded reads ----------------------------------------------------------------


def since(df: DataFrame, as_of: datetime | Column, hours: int, column: str = "published_at") -> DataFrame:
    """Rows at or after `as_of` less some hours; also on the partition date, so days are pruned."""
    cutoff = F.lit(as_of) - F.make_interval(hours=F.lit(hours))
    found = df.filter(F.col(column) >= cutoff)
    if column == "published_at" and "published_date" in df.columns:
        found = found.filter(F.col("published_date") >= F.to_date(cutoff))
    return found


def newest(df: DataFrame, n: int, column: str = "published_at", key: str = "article_hash") -> DataFrame:
    """Top-n by time, ties by hash: a partial top-n in each task, then one merge of n rows each."""
    return df.orderBy(F.col(column).desc(), F.col(key)).limit(n)


def recent(results: DataFrame, as_of: datetime | Column, hours: int = 24, limit: int = 500) -> DataFrame:
    between("hours", hours, 0, 720)
    return newest(since(results, as_of, hours), limit)


def ticker_mentions(
    results: DataFrame, ticker: str, as_of: datetime | Column, hours: int = 24
) -> DataFrame:
    """All rows of the window that name the ticker."""
    between("hours", hours, 1, 168)
    return since(results.filter(F.array_contains("tickers", ticker.upper())), as_of, hours)


def by_ticker(
    results: DataFrame, ticker: str, as_of: datetime | Column, hours: int = 24,
    params: Params = DEFAULTS,
) -> DataFrame:
    return newest(ticker_mentions(results, ticker, as_of, hours), params.ticker_row_cap)


def dashboard_filter(
    results: DataFrame,
    as_of: datetime | Column,
    window: str = "24h",
    min_confidence: float = 0.5,
    sentiments: Sequence[str] = SENTIMENTS,
    impacts: Sequence[str] = IMPACTS,
    show_uncertain: bool = True,
) -> DataFrame:
    kept = since(results, as_of, WINDOW_HOURS[window]).filter(
        (F.col("ensemble_confidence") >= min_confidence)
        & F.col("ensemble_sentiment").isin(*sentiments)
        & F.col("market_impact").isin(*impacts)
    )
    return kept if show_uncertain else kept.filter(~F.col("is_uncertain"))


def uncertain_flag(results: DataFrame, threshold: float) -> DataFrame:
    """The flag again under another threshold; strict."""
    return results.withColumn("is_uncertain", F.col("ensemble_uncertainty") > F.lit(threshold))


def latest_n(results: DataFrame, n: int = 100, params: Params = DEFAULTS) -> DataFrame:
    """Newest n of the newest `latest_cap`."""
    between("n", n, 1, params.latest_cap)
    return newest(results, n)


def latest_cache(results: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """What the latest-results cache holds: bounded by `latest_cap`."""
    return newest(results, params.latest_cap)


def live_feed(results: DataFrame, n: int = 200) -> DataFrame:
    return newest(results, n)


def load_results(results: DataFrame, limit: int = 500) -> DataFrame:
    return newest(results, limit)


def latest_or_recent(cache: DataFrame, results: DataFrame, as_of: datetime | Column, n: int = 50) -> DataFrame:
    """The cache where it holds anything, else the last 24 hours of the table."""
    between("n", n, 1, 500)
    filled = cache.limit(1).agg(F.count("*").alias("n")).select(F.col("n") > 0).scalar()
    columns = [c for c in cache.columns if c in results.columns]
    fallback = recent(results, as_of, 24, n).filter(~filled)
    return newest(cache, n).select(*columns).unionByName(fallback.select(*columns))


def scatter_sample(results: DataFrame, n: int = 300, key: str = "article_hash") -> DataFrame:
    """A repeatable random sample of min(n, rows): the smallest hashes of the key."""
    return results.orderBy(F.md5(key), key).limit(n).select(
        "article_hash", "ensemble_confidence", "ensemble_uncertainty", "ensemble_sentiment",
        "headline", "source",
    )


_TABLE_COLUMNS = (
    "published_at", "headline", "source", "ensemble_sentiment", "ensemble_confidence",
    "ensemble_uncertainty", "market_impact", "tickers", "is_uncertain",
)


def article_table(results: DataFrame, n: int = 100) -> DataFrame:
    """The feed table: those of its columns that are there, newest first."""
    return newest(results, n).select(*[c for c in _TABLE_COLUMNS if c in results.columns])
