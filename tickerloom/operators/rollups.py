"""Aggregates over the result table. All combine in the map stage before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.probability import rounded
from tickerloom.functions.vocab import E2E_BUCKETS, SENTIMENTS
from tickerloom.operators.ordering import quantiles
from tickerloom.operators.results import between, newest, since, ticker_mentions
from tickerloom.operators.sketches import exact_quantiles
from tickerloom.params import DEFAULTS, Params

# Rollup column -> result column.
AVERAGES = {
    "avg_confidence": "ensemble_confidence",
    "avg_uncertainty": "ensemble_uncertainty",
    "avg_positive": "positive_prob",
    "avg_negative": "negative_prob",
    "avg_neutral": "neutral_prob",
    "avg_hedge": "hedge_score",
}
ROLLUP_KEYS = ("bucket", "source", "ensemble_sentiment")


def _is(sentiment: str) -> Column:
    return F.col("ensemble_sentiment") == sentiment


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def hourly_rollup(results: DataFrame) -> DataFrame:
    return results.groupBy(
        F.date_trunc("hour", "published_at").alias("bucket"), "source", "ensemble_sentiment"
    ).agg(
        F.count("*").alias("article_count"),
        *[F.avg(source).alias(name) for name, source in AVERAGES.items()],
    )


def hourly_partials(results: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Counts and sums: the mergeable form of the rollup."""
    return results.groupBy(
        (bucket if bucket is not None else F.date_trunc("hour", "published_at")).alias("bucket"),
        "source", "ensemble_sentiment",
    ).agg(
        F.count("*").alias("article_count"),
        *[F.sum(source).alias(name.replace("avg_", "sum_")) for name, source in AVERAGES.items()],
    )


def merge_partials(partials: DataFrame) -> DataFrame:
    """Partials of any number of batches to the rollup."""
    merged = partials.groupBy(*ROLLUP_KEYS).agg(
        F.sum("article_count").alias("article_count"),
        *[F.sum(n.replace("avg_", "sum_")).alias(n) for n in AVERAGES],
    )
    return merged.select(
        *ROLLUP_KEYS, "article_count",
        *[(F.col(n) / F.col("article_count")).alias(n) for n in AVERAGES],
    )


def query_hourly(rollup: DataFrame, as_of: datetime | Column, hours: int = 48) -> DataFrame:
    between("hours", hours, 1, 720)
    return since(rollup, as_of, hours, "bucket").orderBy(
        F.col("bucket").desc(), "source", "ensemble_sentiment"
    )


def hourly_by_sentiment(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("bucket", "ensemble_sentiment").agg(
        F.sum("article_count").alias("article_count")
    )


def _ticker_shares(n: Column) -> list[Column]:
    pos, neg = F.count_if(_is("positive")), F.count_if(_is("negative"))
    return [
        rounded(pos / n, 4).alias("positive_pct"),
        rounded(neg / n, 4).alias("negative_pct"),
        rounded((n - pos - neg) / n, 4).alias("neutral_pct"),
        rounded(F.avg("ensemble_confidence"), 4).alias("avg_confidence"),
    ]


def ticker_summary(
    results: DataFrame, ticker: str, as_of: datetime | Column, hours: int = 24,
    newest_rows: int | None = None,
) -> DataFrame:
    """One row over all mentions of a ticker, or so many of the newest; no row where there are none."""
    rows = ticker_mentions(results, ticker, as_of, hours)
    if newest_rows is not None:
        rows = newest(rows, newest_rows)
    n = F.count("*")
    return (
        rows.groupBy(F.lit(ticker.upper()).alias("ticker"), F.lit(hours).alias("hours"))
        .agg(n.alias("article_count"), *_ticker_shares(n))
        .withColumn("source", F.lit("db"))
    )


def ticker_aggregates(batch: DataFrame) -> DataFrame:
    """Shares and averages of each ticker mentioned in a batch."""
    n = F.count("*")
    mentions = batch.select(
        F.explode("tickers").alias("ticker"), "ensemble_sentiment", "ensemble_confidence",
        "ensemble_uncertainty",
    )
    return mentions.groupBy("ticker").agg(
        n.alias("article_count"),
        *_ticker_shares(n),
        rounded(F.avg("ensemble_uncertainty"), 4).alias("avg_uncertainty"),
    )


def ticker_cache_or_table(
    cached: DataFrame, results: DataFrame, ticker: str, as_of: datetime | Column, hours: int = 24,
    newest_rows: int | None = None,
) -> DataFrame:
    """The cached record of a ticker, else its summary from the table; `source` tells which."""
    wanted = cached.filter(F.col("ticker") == ticker.upper()).withColumn("source", F.lit("cache"))
    summary = ticker_summary(results, ticker, as_of, hours, newest_rows)
    return wanted.unionByName(
        summary.join(wanted.select("ticker"), "ticker", "left_anti"), allowMissingColumns=True
    )


def kpis(results: DataFrame) -> DataFrame:
    """Headline numbers in percent; zeros for an empty frame."""
    n = F.count("*")

    def percent(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0)) * 100

    counted = results.agg(
        n.alias("articles"),
        percent(F.avg(_is("positive").cast("double"))).alias("positive_pct"),
        percent(F.avg(_is("negative").cast("double"))).alias("negative_pct"),
        percent(F.avg("ensemble_confidence")).alias("avg_confidence_pct"),
        percent(F.avg("ensemble_uncertainty")).alias("avg_uncertainty_pct"),
    )
    return counted.withColumn("positive_vs_half_pp", F.col("positive_pct") - 50)


def sentiment_mix(results: DataFrame) -> DataFrame:
    """Count and share of each sentiment; the window runs over the few grouped rows."""
    counts = results.groupBy("ensemble_sentiment").agg(F.count("*").alias("article_count"))
    everything = Window.partitionBy()
    return counts.withColumn(
        "share", F.col("article_count") / F.sum("article_count").over(everything)
    )


def ticker_heatmap(results: DataFrame, k: int = 20) -> DataFrame:
    """Counts by ticker and sentiment of the k tickers with most mentions, ties by name."""
    mentions = results.select(F.explode("tickers").alias("ticker"), "ensemble_sentiment")
    pivoted = mentions.groupBy("ticker").agg(
        *[F.count_if(_is(s)).alias(s) for s in SENTIMENTS], F.count("*").alias("total")
    )
    return pivoted.orderBy(F.col("total").desc(), "ticker").limit(k)


FIVE_NUMBERS = {"lowest": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "highest": 1.0}


def confidence_distribution(
    results: DataFrame, params: Params = DEFAULTS, sketches: DataFrame | None = None
) -> DataFrame:
    """Five-number summary per sentiment, 1.5 IQR fences and the number of rows outside them.

    With stored sketches of these rows, by sentiment, few of the distinct confidences are ordered.
    """
    key = "ensemble_sentiment"
    value, buckets = "ensemble_confidence", params.order_buckets
    if sketches is None:
        summary = quantiles(results, value, FIVE_NUMBERS, by=[key], buckets=buckets)
    else:
        summary = exact_quantiles(results, sketches, value, FIVE_NUMBERS, by=[key], buckets=buckets)
    iqr = F.col("q3") - F.col("q1")
    fenced = summary.withColumn("lower_fence", F.col("q1") - 1.5 * iqr).withColumn(
        "upper_fence", F.col("q3") + 1.5 * iqr
    )
    # One row per class of a fixed domain: the broadcast is bounded.
    c = F.col("ensemble_confidence")
    outside = (
        results.select(key, "ensemble_confidence")
        .join(F.broadcast(fenced.select(key, "lower_fence", "upper_fence")), key)
        .groupBy(key)
        .agg(
            F.count("*").alias("article_count"),
            F.count_if((c < F.col("lower_fence")) | (c > F.col("upper_fence"))).alias("outliers"),
        )
    )
    return fenced.join(outside, key)


def run_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.avg("ensemble_confidence").alias("avg_confidence"),
        F.avg("ensemble_uncertainty").alias("avg_uncertainty"),
        F.count_if("is_uncertain").alias("uncertain_count"),
        F.count("*").alias("total"),
    )


def label_counts(results: DataFrame) -> DataFrame:
    """Count and share of each class, in class order, zeros included."""
    counted = results.agg(*[F.count_if(_is(s)).alias(s) for s in SENTIMENTS])
    total = sum((F.col(s) for s in SENTIMENTS[1:]), F.col(SENTIMENTS[0]))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("class_ix"), F.lit(s).alias("label"),
                F.col(s).alias("label_count"), _share(F.col(s), total).alias("share"),
            )
            for i, s in enumerate(SENTIMENTS)
        ]
    )
    return counted.select(F.inline(rows))


def latency_histogram(
    log: DataFrame, seconds: str = "seconds", buckets: Sequence[float] = E2E_BUCKETS
) -> DataFrame:
    """Cumulative counts at or below each bound, and all rows under infinity."""
    value = F.col(seconds)
    counted = log.agg(
        *[F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(buckets)],
        F.count(value).alias("le_inf"),
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("cumulative_count"))
            for i, b in enumerate(buckets)
        ],
        F.struct(F.lit(float("inf")).alias("le"), F.col("le_inf").alias("cumulative_count")),
    )
    return counted.select(F.inline(rows))


def throughput(batches: DataFrame, batch: str, started: str, ended: str) -> DataFrame:
    """Rows per second of each batch, from the first start to the last end."""
    span = (F.unix_micros(F.max(ended)) - F.unix_micros(F.min(started))) / 1e6
    return batches.groupBy(batch).agg(
        F.count("*").alias("rows"),
        span.alias("elapsed_s"),
        F.when(span > 0, F.count("*") / span).alias("rows_per_s"),
    )
