"""Streaming jobs run to the end of the given tables, their output read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.probability import rounded
from tickerloom.operators.results import result_dict
from tickerloom.operators.rollups import AVERAGES
from tickerloom.plans import payloads as pl
from tickerloom.plans import views as vw
from tickerloom.session import prepare, shared_dir
from tickerloom.sources.topic import to_topic
from tickerloom.streaming import jobs, keyed


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table as a file stream. The table is a file or a folder of files: as a pattern, its path may be either."""
    schema = vw.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}}}.parquet")


def _place(spark: SparkSession, name: str) -> str:
    prepare(spark)
    return shared_dir(spark, "streams", f"{name}-{uuid.uuid4().hex}")


def _finish(writer: jobs.DataStreamWriter, path: str) -> None:
    jobs.start(writer, f"{path}/checkpoint").awaitTermination()


def _lag() -> object:
    return F.col("published_at") + F.make_interval(secs=F.lit(5))


def _result_stream(spark: SparkSession, sf: str) -> DataFrame:
    stored = vw.results(spark, sf)
    path = vw.stored_path(spark, sf)
    return spark.readStream.schema(stored.schema).parquet(path)


def stream_enrich(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "enrich")
    articles = vw.as_articles(_stream(spark, sf, "documents"))
    messages = pl.damaged(to_topic(articles))
    _finish(jobs.enrich_stream(messages, vw.scorer, path, vw.STORE_PARAMS, _lag()), path)
    found = spark.read.parquet(f"{path}/results")
    return found.select(
        "article_hash", "ensemble_sentiment", "market_impact", "is_uncertain",
        F.array_join("tickers", ",").alias("tickers"),
        *[rounded(F.col(c), 6).alias(c) for c in
          ("ensemble_confidence", "ensemble_uncertainty", "hedge_score")],
    )


def stream_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "dead")
    articles = vw.as_articles(_stream(spark, sf, "documents"))
    messages = pl.damaged(to_topic(articles))
    _finish(jobs.enrich_stream(messages, vw.scorer, path, vw.STORE_PARAMS, _lag()), path)
    dead = spark.read.parquet(f"{path}/dead")
    return dead.groupBy("_dlq_reason").agg(F.count("*").alias("messages"))


_PARTS = 4


def _in_parts(
    rows: DataFrame, path: str, part: Column, job: Callable[[DataFrame], jobs.DataStreamWriter],
    parts: Iterable[int] = range(_PARTS),
) -> None:
    """Run a stream over rows that arrive in numbered parts: for each part one run to the end of the
    input, the later ones as restarts from the checkpoint.

    The parts are written once, by all tasks; what arrives is a copy of one of them.
    """
    spark = rows.sparkSession
    rows.withColumn("__part", part.cast("int")).write.partitionBy("__part").parquet(f"{path}/all")
    stored = spark.read.parquet(f"{path}/all")
    for k in parts:
        stored.filter(F.col("__part") == k).drop("__part").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        _finish(job(stream), path)


def stream_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Four micro-batches in order of time, merged after two of them; hours lie in two parts."""
    path = _place(spark, "hourly")
    stored = vw.results(spark, sf)
    ident = vw.doc_id()
    size = stored.agg(F.max(ident) + 1).first()[0] or 1
    part = F.floor(ident * _PARTS / size)
    _in_parts(stored, path, part, lambda s: jobs.hourly_stream(s, f"{path}/log", compact_every=2))
    found = jobs.read_hourly(spark, f"{path}/log")
    return found.select(
        F.date_format("bucket", "yyyy-MM-dd'T'HH:mm:ss").alias("bucket"), "source",
        "ensemble_sentiment", "article_count",
        *[rounded(F.col(c), 6).alias(c) for c in AVERAGES],
    )


def _arriving(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    """All documents with their arrival times, and the part of the arrivals that each belongs to."""
    docs = vw.raw_docs(spark, sf)
    size = docs.agg(F.max("ordinal") + 1).first()[0] or 1
    after = F.floor(F.col("ordinal") * vw.ARRIVAL_SPAN / size)
    timed = docs.withColumn(
        "ingest_ts", F.timestamp_seconds(F.unix_timestamp(F.lit(vw.START)) + after)
    )
    return timed, F.floor(F.col("ordinal") * _PARTS / size)


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "dedup")
    rows, part = _arriving(spark, sf)
    # Stopped and restarted half-way.
    half = F.floor(part / 2)
    _in_parts(rows, path, half, lambda s: jobs.dedup_exact_stream(s, path), range(2))
    return spark.read.parquet(f"{path}/kept").select("ordinal", "content_hash")


def stream_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "near")
    rows, part = _arriving(spark, sf)
    _in_parts(rows, path, part, lambda s: jobs.dedup_near_stream(s, path))
    return spark.read.parquet(f"{path}/kept").select("ordinal", "content_hash")


#: Shorter than the four minutes after which a phrase comes round again.
_TTL = 200


def stream_ticker_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Records that expire. The first quarter of the time is stored and loaded as initial state, the
    other three arrive as micro-batches of their own."""
    path = _place(spark, "ttl")
    stored = vw.results(spark, sf).select("tickers", "ensemble_sentiment", "published_at")
    span = stored.agg(F.unix_micros(F.min("published_at")).alias("low"), F.unix_micros(F.max("published_at")).alias("high")).first()
    size = ((span.high or 0) - (span.low or 0)) // _PARTS + 1
    part = F.floor((F.unix_micros("published_at") - F.lit(span.low)) / F.lit(size))
    keyed.ticker_sessions(stored.filter(part == 0), _TTL).write.parquet(f"{path}/before")
    initial = spark.read.parquet(f"{path}/before")
    later = stored.filter(part > 0)
    _in_parts(later, path, part, lambda s: jobs.ticker_record_stream(s, f"{path}/changes", _TTL, initial), range(1, _PARTS))
    # A ticker that is not mentioned again has its initial record.
    changes = spark.read.parquet(f"{path}/changes").unionByName(
        initial.withColumns({"expired": F.lit(False), "batch_id": F.lit(-1)})
    )
    return keyed.alive_records(changes, vw.as_of(stored), _TTL).select(
        "ticker", "article_count", "positive_count", "negative_count", "neutral_count",
        F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
    )


def stream_ticker_state(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "tickers")
    now = F.timestamp_seconds(F.unix_timestamp(F.lit(vw.START)))
    _finish(jobs.ticker_state_stream(_result_stream(spark, sf), f"{path}/state", now), path)
    state = jobs.read_latest(spark, f"{path}/state")
    return state.select(
        "ticker", "article_count", "positive_count", "negative_count", "neutral_count"
    )


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "latest")
    _finish(jobs.latest_stream(_result_stream(spark, sf), f"{path}/cache"), path)
    cache = jobs.read_latest(spark, f"{path}/cache")
    return cache.select(
        "article_hash", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at")
    )


def stream_publish(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "publish")
    wire = result_dict(_result_stream(spark, sf))
    _finish(jobs.publish_stream(wire, f"{path}/out"), path)
    sent = spark.read.text(f"{path}/out")
    return sent.select(
        *[F.get_json_object("value", f"$.{c}").alias(c) for c in
          ("article_hash", "ensemble_sentiment", "market_impact", "model_count")]
    )


STREAM_QUERIES = {
    f.__name__: f
    for f in (
        stream_enrich, stream_dead_letters, stream_hourly, stream_dedup, stream_near_dedup,
        stream_ticker_state, stream_ticker_ttl, stream_latest, stream_publish,
    )
}
