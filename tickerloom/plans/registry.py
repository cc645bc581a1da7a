"""Every operator as a named query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.functions.fingerprint import simhash64
from tickerloom.functions.probability import rounded
from tickerloom.functions.vocab import E2E_BUCKETS, PRODUCE_BUCKETS
from tickerloom.operators import dedup as dd
from tickerloom.operators import drift as dr
from tickerloom.operators import evaluate as ev
from tickerloom.operators import limits as li
from tickerloom.operators import models as mo
from tickerloom.operators import profiles as pr
from tickerloom.operators import results as rs
from tickerloom.operators import rollups as ro
from tickerloom.operators import scoring as sc
from tickerloom.operators import sketches as sk
from tickerloom.params import Params
from tickerloom.plans import payloads as pl
from tickerloom.plans import toymodels as toy
from tickerloom.plans import views as vw
from tickerloom.session import shared_dir
from tickerloom.sources import feeds, keyindex, postings, tables, topic

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_PROBS = ("positive_prob", "negative_prob", "neutral_prob")


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def _joined(array: str) -> Column:
    return F.array_join(array, ",").alias(array)


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss").alias(column)


def _r6(*columns: str) -> list[Column]:
    return [rounded(F.col(c), 6).alias(c) for c in columns]


def _keyed(spark: SparkSession, sf: str) -> DataFrame:
    return vw.articles(spark, sf).withColumn("doc_id", vw.doc_id())


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return vw.model_scores(vw.articles(spark, sf).select("content_hash", "url"))


def _passes(spark: SparkSession, sf: str) -> DataFrame:
    return vw.dropout_passes(vw.articles(spark, sf).select("content_hash", "url"))


# --- text features -------------------------------------------------------------------------------


@query
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _keyed(spark, sf).select("doc_id", "content_hash")


@query
def full_text(spark: SparkSession, sf: str) -> DataFrame:
    text = tx.full_text(F.col("headline"), F.col("body"))
    return _keyed(spark, sf).select("doc_id", text.alias("full_text"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return tx.with_features(_keyed(spark, sf).select("doc_id", "headline", "body"))


@query
def hedge_score(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("doc_id", *_r6("hedge_score"))


@query
def negation(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("doc_id", "has_negation")


@query
def forward_looking(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("doc_id", "is_forward_looking")


@query
def tickers(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("doc_id", _joined("tickers"))


@query
def sectors(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("doc_id", _joined("sectors"))


@query
def sector_counts(spark: SparkSession, sf: str) -> DataFrame:
    mentions = vw.results(spark, sf).select(F.explode("tickers").alias("ticker"))
    return tx.sector_dimension(mentions).groupBy("sector").agg(F.count("*").alias("mentions"))


@query
def market_impact(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select("doc_id", "market_impact")


@query
def features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf).select(
        "doc_id", _joined("tickers"), _joined("sectors"), "is_forward_looking", "has_negation",
        *_r6("hedge_score"), "market_impact",
    )


# --- models and ensemble ---------------------------------------------------------------------------


@query
def score_udf(spark: SparkSession, sf: str) -> DataFrame:
    keyed = vw.articles(spark, sf).withColumnRenamed("content_hash", "article_hash")
    scored = sc.score_texts(keyed, toy.MODELS)
    return scored.select("article_hash", "model_ix", *_r6(*_PROBS))


@query
def entities(spark: SparkSession, sf: str) -> DataFrame:
    found = mo.with_entities(_keyed(spark, sf).select("doc_id", "headline"), toy.entities)
    return found.select("doc_id", F.inline("entities")).select(
        "doc_id", "text", "entity_type", *_r6("confidence"), "start_char", "end_char"
    )


@query
def impact_fallback(spark: SparkSession, sf: str) -> DataFrame:
    asked = mo.with_impact_fallback(_keyed(spark, sf).select("doc_id", "headline"), toy.impact)
    impact = tx.market_impact(F.col("headline"), F.col("fallback_impact"))
    return asked.select("doc_id", impact.alias("market_impact"))


@query
def score_leading(spark: SparkSession, sf: str) -> DataFrame:
    """The first 512 words of whole articles, 32 texts at a time."""
    keyed = vw.articles(spark, sf).withColumnRenamed("content_hash", "article_hash")
    scored = sc.score_texts(keyed, toy.MODELS, batch_size=32, max_tokens=512)
    return scored.select("article_hash", "model_ix", *_r6(*_PROBS))


@query
def entities_batched(spark: SparkSession, sf: str) -> DataFrame:
    found = mo.with_entities(_keyed(spark, sf).select("doc_id", "headline"), batch_fn=toy.entities_of_all)
    return found.select("doc_id", F.inline("entities")).select(
        "doc_id", "text", "entity_type", *_r6("confidence"), "start_char", "end_char"
    )


@query
def impact_fallback_batched(spark: SparkSession, sf: str) -> DataFrame:
    keyed = _keyed(spark, sf).select("doc_id", "headline")
    asked = mo.with_impact_fallback(keyed, batch_fn=toy.impact_of_all)
    impact = tx.market_impact(F.col("headline"), F.col("fallback_impact"))
    return asked.select("doc_id", impact.alias("market_impact"))


@query
def model_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return sc.model_argmax(_scores(spark, sf))


@query
def ensemble(spark: SparkSession, sf: str) -> DataFrame:
    return sc.ensemble_average(_scores(spark, sf)).select("article_hash", *_r6(*_PROBS))


@query
def temperature_scaled(spark: SparkSession, sf: str) -> DataFrame:
    scaled = sc.decide(sc.temperature_scale(sc.ensemble_average(_scores(spark, sf)), 1.5))
    return scaled.select(
        "article_hash", *_r6(*_PROBS, "ensemble_confidence"), "ensemble_sentiment"
    )


@query
def mc_uncertainty(spark: SparkSession, sf: str) -> DataFrame:
    found = sc.mc_uncertainty(_passes(spark, sf))
    return found.select("article_hash", *_r6("ensemble_uncertainty"))


@query
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    found = sc.predict(_scores(spark, sf), _passes(spark, sf), vw.STORE_PARAMS)
    names = F.transform("model_predictions", lambda m: m["sentiment"])
    return found.select(
        "article_hash", *_r6(*_PROBS, "ensemble_confidence", "ensemble_uncertainty"),
        "ensemble_sentiment", "is_uncertain", F.array_join(names, ",").alias("model_sentiments"),
        F.size("model_predictions").alias("model_count"),
    )


@query
def analyse(spark: SparkSession, sf: str) -> DataFrame:
    texts = vw.articles(spark, sf).select(
        F.col("content_hash").alias("article_hash"), F.col("headline").alias("text")
    )
    answered = sc.analyse(texts, _scores(spark, sf), _passes(spark, sf), vw.STORE_PARAMS)
    return answered.select(
        "text", "sentiment", *_r6("confidence", "uncertainty", *_PROBS), "is_uncertain",
        "model_count", "temperature",
    )


@query
def calibrate_temperature(spark: SparkSession, sf: str) -> DataFrame:
    rows = vw.eval_rows(spark, sf).withColumnsRenamed(dict(zip(("p0", "p1", "p2"), _PROBS)))
    return sc.calibrate_temperature(rows).select(
        rounded(F.col("temperature"), 3).alias("temperature"), rounded(F.col("nll"), 6).alias("nll")
    )


@query
def enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Articles to result rows in one plan, without the stored table."""
    rows = vw.enrich(vw.articles(spark, sf))
    return rows.select(
        "article_hash", "headline", "url", "source", _time("published_at"),
        _time("processed_at"), "ensemble_sentiment",
        *_r6("ensemble_confidence", "ensemble_uncertainty", *_PROBS, "hedge_score"),
        F.size("model_predictions").alias("model_count"),
        F.size("entities").alias("entity_count"), _joined("tickers"), _joined("sectors"),
        "is_forward_looking", "has_negation", "market_impact", "is_uncertain",
        "temperature_scaled",
    )


@query
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Results of the first sources, then all results twice: one row per hash, the first wins."""
    stored = vw.results(spark, sf).drop("published_date")
    path = shared_dir(spark, "inserts", uuid.uuid4().hex)
    first = stored.filter(F.col("source") < "src2").withColumn("market_impact", F.lit("first"))
    tables.write_results(first, path)
    tables.write_results(stored.unionByName(stored), path)
    found = tables.read_table(spark, path)
    return found.groupBy("article_hash").agg(
        F.count("*").alias("copies"), F.max("market_impact").alias("market_impact")
    )


# --- serving -----------------------------------------------------------------------------------------


def _brief(df: DataFrame) -> DataFrame:
    return df.select(
        "article_hash", "url", "source", _time("published_at"), "ensemble_sentiment",
        *_r6("ensemble_confidence", "ensemble_uncertainty"), _joined("tickers"), "market_impact",
        "is_uncertain",
    )


@query
def insert_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """Three overlapping batches through the key index and the commit log, the second delivered twice."""
    stored = vw.results(spark, sf)
    path = shared_dir(spark, "indexed", uuid.uuid4().hex)
    ident = vw.doc_id() % 4
    batches = [ident.isin(0, 1), ident.isin(1, 2), ident.isin(1, 2), ident.isin(0, 2, 3)]
    for batch_id, rows in zip((0, 1, 1, 2), batches):
        keyindex.insert_absent(stored.filter(rows), path, batch_id, buckets=32)
    found = keyindex.read_inserted(spark, path)
    return found.select("article_hash", "ensemble_sentiment", _time("published_at"))


@query
def recent(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return _brief(rs.recent(stored, vw.as_of(stored), 1, 500))


@query
def by_ticker(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return _brief(rs.by_ticker(stored, "aapl", vw.as_of(stored), 24))


@query
def dashboard_filter(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return _brief(
        rs.dashboard_filter(
            stored, vw.as_of(stored), "6h", 0.45, ("positive", "negative"), ("high", "medium"),
            show_uncertain=False,
        )
    )


@query
def uncertain_flag(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf).select("article_hash", "ensemble_uncertainty")
    return rs.uncertain_flag(stored, 0.98).select("article_hash", "is_uncertain")


@query
def latest_n(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(rs.latest_n(vw.results(spark, sf), 100))


@query
def live_feed(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(rs.live_feed(vw.results(spark, sf)))


@query
def load_results(spark: SparkSession, sf: str) -> DataFrame:
    return _brief(rs.load_results(vw.results(spark, sf)))


@query
def latest_or_recent(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    cache = rs.latest_cache(stored)
    filled = rs.latest_or_recent(cache, stored, vw.as_of(stored), 50)
    empty = rs.latest_or_recent(cache.filter("false"), stored, vw.as_of(stored), 40)
    return _brief(filled).withColumn("asked", F.lit("filled")).unionByName(
        _brief(empty).withColumn("asked", F.lit("empty"))
    )


@query
def scatter_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rs.scatter_sample(vw.results(spark, sf)).select(
        "article_hash", *_r6("ensemble_confidence", "ensemble_uncertainty"),
        "ensemble_sentiment", "headline", "source",
    )


@query
def article_table(spark: SparkSession, sf: str) -> DataFrame:
    return rs.article_table(vw.results(spark, sf)).select(
        _time("published_at"), "headline", "source", "ensemble_sentiment",
        *_r6("ensemble_confidence", "ensemble_uncertainty"), "market_impact", _joined("tickers"),
        "is_uncertain",
    )


@query
def article_wire(spark: SparkSession, sf: str) -> DataFrame:
    return rs.article_dict(vw.articles(spark, sf))


@query
def result_wire(spark: SparkSession, sf: str) -> DataFrame:
    wire = rs.result_dict(vw.results(spark, sf))
    return wire.select(
        *[_joined(c) if c in ("tickers", "sectors") else F.col(c) for c in wire.columns]
    )


@query
def text_store(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf).select(
        "article_hash", "tickers", "sectors", "is_forward_looking", "has_negation",
        "is_uncertain", "published_at",
    )
    flat = tables.flatten_for_text_store(stored)
    back = tables.restore_from_text_store(flat).select(
        "article_hash", F.size("tickers").alias("ticker_count"),
        F.col("is_uncertain").alias("uncertain_again"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_again"),
    )
    return flat.join(back, "article_hash")


# --- rollups -------------------------------------------------------------------------------------------


def _hourly(df: DataFrame) -> DataFrame:
    return df.select(
        _time("bucket"), "source", "ensemble_sentiment", "article_count", *_r6(*ro.AVERAGES)
    )


@query
def hourly_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _hourly(ro.hourly_rollup(vw.results(spark, sf)))


@query
def hourly_partials(spark: SparkSession, sf: str) -> DataFrame:
    """The rollup by way of its mergeable form, one partial per day."""
    stored = vw.results(spark, sf)
    return _hourly(ro.merge_partials(ro.hourly_partials(stored)))


@query
def query_hourly(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return _hourly(ro.query_hourly(ro.hourly_rollup(stored), vw.as_of(stored), 3))


@query
def hourly_by_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    found = ro.hourly_by_sentiment(ro.hourly_rollup(vw.results(spark, sf)))
    return found.select(_time("bucket"), "ensemble_sentiment", "article_count")


@query
def ticker_summary(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return ro.ticker_summary(stored, "nvda", vw.as_of(stored), 48, newest_rows=200)


@query
def ticker_summary_whole(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return ro.ticker_summary(stored, "nvda", vw.as_of(stored), 48)


def _postings(spark: SparkSession, stored: DataFrame) -> DataFrame:
    path = _batches(spark, stored, "postings", lambda b, p, k: postings.add_postings(b, p, k, compact_every=2))
    return postings.read_postings(spark, path)


@query
def ticker_summary_postings(spark: SparkSession, sf: str) -> DataFrame:
    """The summary over all mentions, read from one ticker's inverted list."""
    stored = vw.results(spark, sf)
    own = postings.of_ticker(_postings(spark, stored), "nvda")
    return ro.ticker_summary(own, "nvda", vw.as_of(stored), 48)


@query
def by_ticker_postings(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return _brief(postings.by_ticker(_postings(spark, stored), stored, "aapl", vw.as_of(stored), 24))


@query
def ticker_aggregates(spark: SparkSession, sf: str) -> DataFrame:
    return ro.ticker_aggregates(vw.results(spark, sf))


def _cache_or_table(stored: DataFrame, newest_rows: int | None) -> DataFrame:
    cached = ro.ticker_aggregates(stored.filter(F.col("market_impact") == "medium"))
    now = vw.as_of(stored)
    hit = ro.ticker_cache_or_table(cached, stored, "aapl", now, newest_rows=newest_rows)
    miss = ro.ticker_cache_or_table(cached.filter("false"), stored, "gs", now, newest_rows=newest_rows)
    return hit.unionByName(miss)


@query
def ticker_cache_or_table(spark: SparkSession, sf: str) -> DataFrame:
    return _cache_or_table(vw.results(spark, sf), 200)


@query
def ticker_cache_or_table_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _cache_or_table(vw.results(spark, sf), None)


@query
def kpis(spark: SparkSession, sf: str) -> DataFrame:
    found = ro.kpis(vw.results(spark, sf))
    return found.select("articles", *_r6(*[c for c in found.columns if c != "articles"]))


@query
def sentiment_mix(spark: SparkSession, sf: str) -> DataFrame:
    found = ro.sentiment_mix(vw.results(spark, sf))
    return found.select("ensemble_sentiment", "article_count", *_r6("share"))


@query
def ticker_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return ro.ticker_heatmap(vw.results(spark, sf))


@query
def confidence_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return _distribution_rows(ro.confidence_distribution(vw.results(spark, sf)))


def _batches(spark: SparkSession, rows: DataFrame, name: str, add: Callable[[DataFrame, str, int], object]) -> str:
    """A committed table built by three batches, the last of them delivered twice."""
    path = shared_dir(spark, name, uuid.uuid4().hex)
    for k in (0, 1, 2, 2):
        add(rows.filter(F.pmod(F.xxhash64("article_hash"), F.lit(3)) == k), path, k)
    return path


def _distribution_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "ensemble_sentiment", "article_count", "outliers",
        *_r6("lowest", "q1", "median", "q3", "highest", "lower_fence", "upper_fence"),
    )


@query
def confidence_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """The distribution by way of stored hourly sketches, added in batches and merged."""
    stored = vw.results(spark, sf)
    by, value = ["ensemble_sentiment"], "ensemble_confidence"
    path = _batches(spark, stored, "sketches", lambda b, p, k: sk.add_sketches(b, p, k, value, by, compact_every=2))
    return _distribution_rows(ro.confidence_distribution(stored, sketches=sk.read_sketches(spark, path)))


@query
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ro.run_summary(vw.results(spark, sf)).select(
        *_r6("avg_confidence", "avg_uncertainty"), "uncertain_count", "total"
    )


@query
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ro.label_counts(vw.results(spark, sf)).select(
        "class_ix", "label", "label_count", *_r6("share")
    )


def _latencies(spark: SparkSession, sf: str) -> DataFrame:
    return vw.table(spark, sf, "events").select((F.col("value") / 10).alias("seconds"))


def _histogram(found: DataFrame) -> DataFrame:
    return found.select(F.format_string("%.3f", "le").alias("le"), "cumulative_count")


@query
def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(ro.latency_histogram(_latencies(spark, sf), buckets=E2E_BUCKETS))


@query
def produce_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _histogram(ro.latency_histogram(_latencies(spark, sf), buckets=PRODUCE_BUCKETS))


@query
def throughput(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf).withColumn("batch", F.date_trunc("hour", "published_at"))
    found = ro.throughput(stored, "batch", "published_at", "processed_at")
    return found.select(_time("batch"), "rows", *_r6("elapsed_s", "rows_per_s"))


_LIMIT = Params(rate_limit=2, rate_window_seconds=3_600)


@query
def rate_limit_sliding(spark: SparkSession, sf: str) -> DataFrame:
    events = vw.table(spark, sf, "events")
    return li.sliding(events, "user_id", "ts", "event_id", _LIMIT).drop("ts")


@query
def rate_limit_idle(spark: SparkSession, sf: str) -> DataFrame:
    events = vw.table(spark, sf, "events")
    return li.idle_reset(events, "user_id", "ts", "event_id", _LIMIT).drop("ts")


# --- de-duplication --------------------------------------------------------------------------------------


@query
def dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return dd.dedup_exact(vw.raw_docs(spark, sf)).select("ordinal", "content_hash")


@query
def simhash(spark: SparkSession, sf: str) -> DataFrame:
    fingerprint = F.lower(F.lpad(F.hex(simhash64(F.col("headline"))), 16, "0"))
    return vw.raw_docs(spark, sf).select("ordinal", fingerprint.alias("fingerprint"))


@query
def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    prints = dd.fingerprints(vw.raw_docs(spark, sf)).select("fp").distinct()
    found = dd.near_pairs(prints)

    def name(c: str) -> Column:
        return F.lower(F.lpad(F.hex(c), 16, "0"))

    return found.select(
        F.least(name("fp_a"), name("fp_b")).alias("fp_low"),
        F.greatest(name("fp_a"), name("fp_b")).alias("fp_high"), "distance",
    )


@query
def dedup_near(spark: SparkSession, sf: str) -> DataFrame:
    kept = dd.dedup(vw.raw_docs(spark, sf))
    return kept.select("ordinal", "content_hash")


@query
def drop_seen(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose hash does not occur under another source."""
    docs = vw.raw_docs(spark, sf)
    seen = docs.filter(F.col("source") == "src0")
    return dd.drop_seen(docs.filter(F.col("source") != "src0"), seen).select("ordinal")


# --- evaluation ----------------------------------------------------------------------------------------


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return ev.confusion_matrix(vw.eval_rows(spark, sf))


@query
def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.class_metrics(vw.eval_rows(spark, sf)).select(
        "class_name", *_r6("precision", "recall", "f1", "share"), "support"
    )


@query
def f1_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ev.f1_summary(vw.eval_rows(spark, sf)).select(
        "n_samples", *_r6("accuracy", "macro_f1", "micro_f1", "weighted_f1")
    )


@query
def mcc_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return ev.f1_summary(vw.eval_rows(spark, sf)).select(*_r6("mcc", "cohen_kappa"))


@query
def rank_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.rank_metrics(vw.eval_rows(spark, sf)).select(
        "class_name", *_r6("roc_auc", "pr_auc")
    )


@query
def ece_bins(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ece_bins(vw.eval_rows(spark, sf)).select(
        "bin", "n", *_r6("accuracy", "mean_confidence")
    )


@query
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return ev.ece(vw.eval_rows(spark, sf)).select(*_r6("ece"))


@query
def brier_and_rates(spark: SparkSession, sf: str) -> DataFrame:
    params = Params(uncertainty_threshold=0.98)
    return ev.rates(vw.eval_rows(spark, sf), params).select(
        *_r6("brier_score", "ensemble_disagreement", "uncertain_fraction")
    )


@query
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    return ev.reliability(vw.eval_rows(spark, sf)).select(
        "bin", "n", *_r6("mean_predicted_prob", "fraction_positive")
    )


@query
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return ev.latency_percentiles(vw.eval_rows(spark, sf))


@query
def latency_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the log by way of stored hourly sketches."""
    times = vw.results(spark, sf).select("article_hash", "published_at")
    rows = vw.eval_rows(spark, sf).select("article_hash", "latency_ms").join(times, "article_hash")
    path = _batches(spark, rows, "latency", lambda b, p, k: sk.add_sketches(b, p, k, "latency_ms", compact_every=2))
    return ev.latency_percentiles(rows, sketches=sk.read_sketches(spark, path))


@query
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return ev.flatten_report(vw.eval_rows(spark, sf)).select("metric", *_r6("value"))


@query
def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    wide = ev.evaluate(vw.eval_rows(spark, sf))
    return wide.select("n_samples", *_r6(*[c for c in wide.columns if c != "n_samples"]))


@query
def noisy_truth(spark: SparkSession, sf: str) -> DataFrame:
    rows = vw.eval_rows(spark, sf).select("article_hash", "y_true")
    return ev.noisy_truth(rows, "article_hash")


@query
def label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Quality labels as known truth: 1 is positive, 0 is negative, the others keep the prediction."""
    labels = vw.table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label")
    )
    stored = vw.results(spark, sf).select(
        vw.doc_id().alias("doc_id"), vw.sentiment_index(F.col("ensemble_sentiment")).alias("y_pred")
    )
    return ev.labels_or_prediction(stored, labels, "doc_id")


# --- drift ---------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Results of medium or unknown impact against those of high impact."""
    stored = vw.results(spark, sf)
    high = F.col("market_impact") == "high"
    return stored.filter(~high), stored.filter(high)


@query
def psi(spark: SparkSession, sf: str) -> DataFrame:
    return dr.psi(*_sides(spark, sf))


@query
def chi2(spark: SparkSession, sf: str) -> DataFrame:
    return dr.chi2_label_drift(*_sides(spark, sf))


@query
def js(spark: SparkSession, sf: str) -> DataFrame:
    return dr.js_divergence(*_sides(spark, sf))


def _alerts(report: DataFrame) -> DataFrame:
    return report.drop("timestamp").withColumn("alerts", F.array_join("alerts", "; "))


@query
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    sure = F.col("ensemble_confidence") > 0.5
    return _alerts(dr.drift_report(stored.filter(~sure), stored.filter(sure)))


@query
def drift_check(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return _alerts(dr.drift_check(stored, vw.as_of(stored)))


def _profiles(spark: SparkSession, stored: DataFrame) -> DataFrame:
    path = _batches(spark, stored, "profiles", lambda b, p, k: pr.add_profiles(b, p, k, compact_every=2))
    return pr.read_profiles(spark, path)


@query
def drift_check_profiled(spark: SparkSession, sf: str) -> DataFrame:
    """The drift check from stored hourly profiles and the rows of two broken hours."""
    stored = vw.results(spark, sf)
    return _alerts(pr.drift_check(_profiles(spark, stored), stored, vw.as_of(stored)))


@query
def drift_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """The drift check at the end of every hour, by a moving window over profiles."""
    found = pr.drift_hourly(_profiles(spark, vw.results(spark, sf)))
    return _alerts(found.withColumn("checked_at", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")))


@query
def drift_check_capped(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    return _alerts(dr.drift_check(stored, vw.as_of(stored), newest_current=500, newest_reference=2_000))


@query
def drift_metrics(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    sure = F.col("ensemble_confidence") > 0.5
    return dr.drift_metrics(dr.drift_report(stored.filter(~sure), stored.filter(sure)))


@query
def drift_split_half(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(dr.drift_split_half(vw.results(spark, sf)))


# --- sources -------------------------------------------------------------------------------------------


def _article_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "payload_id", "pos", "source", "headline", "url", _time("published_at"), "body", "author",
        "content_hash",
    )


@query
def normalize_newsapi(spark: SparkSession, sf: str) -> DataFrame:
    return _article_rows(feeds.normalize_newsapi(pl.newsapi(spark, sf)))


@query
def normalize_rss(spark: SparkSession, sf: str) -> DataFrame:
    return _article_rows(feeds.normalize_rss(pl.rss(spark, sf)))


@query
def normalize_rss_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 items of each feed document."""
    return _article_rows(feeds.normalize_rss(pl.rss(spark, sf), Params(feed_item_cap=20)))


@query
def normalize_av(spark: SparkSession, sf: str) -> DataFrame:
    return _article_rows(feeds.normalize_alpha_vantage(pl.alpha_vantage(spark, sf)))


def _fetched(spark: SparkSession, sf: str, params: Params = Params()) -> list[DataFrame]:
    return [
        feeds.normalize_newsapi(pl.newsapi(spark, sf)),
        feeds.normalize_rss(pl.rss(spark, sf), params),
        feeds.normalize_alpha_vantage(pl.alpha_vantage(spark, sf)),
    ]


def _fetched_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "source", "headline", "url", _time("published_at"), "body", "author", "content_hash"
    )


@query
def fetch_all(spark: SparkSession, sf: str) -> DataFrame:
    return _fetched_rows(feeds.fetch_all(_fetched(spark, sf)))


@query
def fetch_all_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 items of each feed document, and of all unique articles the newest 100."""
    capped = Params(feed_item_cap=20, fetch_cap=100)
    return _fetched_rows(feeds.fetch_all(_fetched(spark, sf, capped), capped))


@query
def fetch_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Exact de-duplication across the three sources."""
    fetched = feeds.union_sources(_fetched(spark, sf))
    kept = dd.dedup_exact(fetched, arrival="arrival")
    errors = feeds.failed_payloads(
        pl.newsapi(spark, sf).withColumn("payload", F.concat(F.lit("!"), "payload")), "newsapi"
    )
    return feeds.fetch_stats(fetched, kept, errors).select(
        "source_kind", "fetched", "deduplicated", "errors", *_r6("yield_rate")
    )


@query
def to_topic(spark: SparkSession, sf: str) -> DataFrame:
    sent = topic.to_topic(vw.articles(spark, sf))
    return sent.select(
        "key", *[F.get_json_object("value", f"$.{c}").alias(c) for c in
                 ("source", "headline", "url", "published_at", "body", "author")]
    )


@query
def decode_messages(spark: SparkSession, sf: str) -> DataFrame:
    good, _ = topic.split_dead_letters(pl.messages(spark, sf))
    return good.select(
        "source", "headline", "url", _time("published_at"), "body", "author", "content_hash"
    )


@query
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    decoded = topic.decode(pl.messages(spark, sf))
    return decoded.filter("_dlq_reason IS NOT NULL").select("id", "_dlq_reason")


@query
def decode_status(spark: SparkSession, sf: str) -> DataFrame:
    return topic.count_decode_status(pl.messages(spark, sf), "error")


def all_queries() -> dict[str, Query]:
    from tickerloom.plans import streams

    return {**_QUERIES, **streams.STREAM_QUERIES}
