"""Input views over the given tables, and the stored result table the serving queries read.

Documents become articles: a phrase that holds financial vocabulary, followed by the whole text, is
the headline; a second phrase is the body. Scores and stochastic passes stand in for the output
of external models: they are drawn from a hash of the document id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.probability import sentiment_index
from tickerloom.functions.text import content_hash
from tickerloom.operators.results import assemble_results
from tickerloom.operators.scoring import predict
from tickerloom.params import Params
from tickerloom.session import prepare, shared_dir, spread_stored
from tickerloom.sources.tables import append_by_date

PHRASES = (
    "AAPL beats estimates after record quarterly revenue",
    "Fed may possibly cut rates, outlook uncertain",
    "TSLA stock crash deepens as demand fades",
    "JPM and GS shares rise on merger talks",
    "XOM profit miss despite higher prices",
    "Small operational update from a supplier",
    "MSFT expects next quarter growth but PFE did not",
    "Dividend and buyback plans by KO",
    "NVDA and AMD could likely surge",
    "ZZZZ Corp names new CEO",
    "BTC and ETH trade sideways",
    "Bank shares roughly flat, no news",
)
STEP_SECONDS = 20
START = "2024-01-01 00:00:00"
#: Seconds from the first to the last arrival of the de-duplication streams: six windows.
ARRIVAL_SPAN = 6 * 86_400

# The mean of ten stand-in passes is near uniform, so the flag needs a high bound to split rows.
STORE_PARAMS = Params(uncertainty_threshold=0.99)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _phrase(ix: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, PHRASES)), (ix % len(PHRASES) + 1).cast("int"))


def hash_number(*parts: Column | str) -> Column:
    """First 8 hex digits of md5 over the parts joined by a bar."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("long")


def as_articles(documents: DataFrame) -> DataFrame:
    ix = F.col("doc_id")
    named = documents.select(
        F.col("source"),
        F.concat(_phrase(ix), F.lit(" "), F.col("text")).alias("headline"),
        F.concat(F.lit("doc://"), F.col("source"), F.lit("/"), ix.cast("string")).alias("url"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + ix * STEP_SECONDS).alias(
            "published_at"
        ),
        _phrase(F.floor(ix / len(PHRASES))).alias("body"),
        F.lit("").alias("author"),
    )
    return named.withColumn("content_hash", content_hash(F.col("headline"), F.col("url")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_articles(spread_stored(table(spark, sf_dir, "documents")))


def raw_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw_docs(spread_stored(table(spark, sf_dir, "documents")))


def as_raw_docs(documents: DataFrame) -> DataFrame:
    """Whole texts as headlines without a URL: copies share a hash."""
    return documents.select(
        F.col("doc_id").alias("ordinal"), "source", F.col("text").alias("headline"),
        content_hash(F.col("text"), F.lit("")).alias("content_hash"),
    )


def doc_id(url: str = "url") -> Column:
    return F.substring_index(F.col(url), "/", -1).cast("long")


def _drawn(*key: Column | str) -> list[Column]:
    """Three probabilities proportional to 1..1000; "?" in the key is the class."""
    parts = []
    for name in ("pos", "neg", "neu"):
        filled = [name if isinstance(k, str) and k == "?" else k for k in key]
        parts.append(1 + hash_number(*filled) % 1000)
    total = parts[0] + parts[1] + parts[2]
    return [p / total for p in parts]


def model_scores(keyed: DataFrame) -> DataFrame:
    """Score rows of three stand-in models for (content_hash, url) rows."""
    each = keyed.select(
        F.col("content_hash").alias("article_hash"), doc_id().alias("id"),
        F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("model_ix"),
    )
    p = _drawn(F.col("id"), F.col("model_ix"), "?")
    return each.select(
        "article_hash", "model_ix", p[0].alias("positive_prob"), p[1].alias("negative_prob"),
        p[2].alias("neutral_prob"),
        (10 + hash_number(F.col("id"), F.col("model_ix"), "l") % 140).cast("double").alias(
            "latency_ms"
        ),
    )


def dropout_passes(keyed: DataFrame, passes: int = 10) -> DataFrame:
    """Ten stand-in stochastic passes for (content_hash, url) rows."""
    each = keyed.select(
        F.col("content_hash").alias("article_hash"), doc_id().alias("id"),
        F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"),
    )
    p = _drawn(F.col("id"), F.col("pass"), "?", "mc")
    return each.select("article_hash", "pass", *[c.alias(f"p{i}") for i, c in enumerate(p)])


def scorer(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    keyed = batch.select("content_hash", "url")
    return model_scores(keyed), dropout_passes(keyed)


def enrich(batch: DataFrame, params: Params = STORE_PARAMS) -> DataFrame:
    """Articles to result rows in one plan; `processed_at` is a fixed lag, to be repeatable."""
    scores, passes = scorer(batch)
    lag = F.make_interval(secs=F.lit(5))
    return assemble_results(
        batch, predict(scores, passes, params), params, processed_at=F.col("published_at") + lag
    )


_stored: dict[tuple[str, str], str] = {}


def stored_path(spark: SparkSession, sf_dir: str) -> str:
    """The stored result table, written once per application below the shared folder."""
    prepare(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        # A new folder each time: a write that failed half way leaves nothing to add to.
        path = shared_dir(spark, "results", uuid.uuid4().hex)
        append_by_date(enrich(articles(spark, sf_dir)), path)
        _stored[key] = path
    return _stored[key]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(stored_path(spark, sf_dir))


def as_of(frame: DataFrame, column: str = "published_at") -> Column:
    """The newest time in the table, as a scalar subquery."""
    return frame.agg(F.max(column)).scalar()


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results as evaluation rows; the truth is right in about seven of ten cases."""
    stored = results(spark, sf_dir)
    ident = doc_id()
    y_pred = sentiment_index(F.col("ensemble_sentiment"))
    right = hash_number(ident, "t") % 10 < 7
    return stored.select(
        "article_hash",
        F.when(right, y_pred).otherwise((hash_number(ident, "u") % 3).cast("int")).alias("y_true"),
        y_pred.alias("y_pred"),
        F.col("positive_prob").alias("p0"), F.col("negative_prob").alias("p1"),
        F.col("neutral_prob").alias("p2"),
        F.transform("model_predictions", lambda m: sentiment_index(m["sentiment"])).alias("preds"),
        F.col("ensemble_uncertainty").alias("uncertainty"),
        (10 + hash_number(ident, "l") % 140).cast("double").alias("latency_ms"),
    )
