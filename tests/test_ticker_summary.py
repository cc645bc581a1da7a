from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tickerloom.operators import rollups as ro

NOW = datetime(2024, 2, 1, 12)
SCHEMA = "article_hash string, published_at timestamp, tickers array<string>, ensemble_sentiment string, ensemble_confidence double, ensemble_uncertainty double"


def test_summary_is_over_all_mentions(spark):
    rows = [
        (f"{i:04}", NOW - timedelta(seconds=i), ["NVDA"], "positive" if i < 200 else "negative", 0.9 if i < 200 else 0.5, 0.1)
        for i in range(250)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = ro.ticker_summary(df, "nvda", NOW).first()
    assert (whole.article_count, whole.positive_pct, whole.negative_pct, whole.avg_confidence) == (250, 0.8, 0.2, 0.82)
    capped = ro.ticker_summary(df, "nvda", NOW, newest_rows=200).first()
    assert (capped.article_count, capped.positive_pct) == (200, 1.0)
    cached = ro.ticker_aggregates(df.filter(F.lit(False)))
    assert ro.ticker_cache_or_table(cached, df, "nvda", NOW).first().article_count == 250
