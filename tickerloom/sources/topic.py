"""Topic messages: encode, decode, dead letters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.text import content_hash
from tickerloom.operators.results import article_dict
from tickerloom.schemas import RAW_ARTICLE, RAW_ARTICLE_WIRE, conform

_REQUIRED = ("source", "headline", "url", "published_at")
_CORRUPT = "_corrupt"

# Sink options that make delivery idempotent and retried; batching and compression.
KAFKA_SINK_OPTIONS = {
    "kafka.acks": "all",
    "kafka.enable.idempotence": "true",
    "kafka.retries": "5",
    "kafka.linger.ms": "5",
    "kafka.batch.size": "32768",
    "kafka.compression.type": "snappy",
    "kafka.delivery.timeout.ms": "30000",
    "kafka.request.timeout.ms": "10000",
}


def read_topic(
    spark: SparkSession, servers: str, topic: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """A Kafka topic from its start as (key, value, timestamp); needs the Kafka connector."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**(options or {}))
    )
    return reader.load().select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "timestamp",
    )


def read_message_files(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A folder of text files, one message per line, as a stream."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def to_topic(articles: DataFrame) -> DataFrame:
    """Key: content hash. Value: the record as JSON."""
    wire = article_dict(articles)
    return wire.select(
        F.col("content_hash").alias("key"),
        F.to_json(F.struct(*[F.col(c) for c in wire.columns])).alias("value"),
    )


def decode(messages: DataFrame, value: str = "value") -> DataFrame:
    """Parse once; add `article` and `_dlq_reason`, which is null for a good message."""
    schema = RAW_ARTICLE_WIRE.simpleString()[len("struct<"):-1] + f",{_CORRUPT}:string"
    parsed = messages.withColumn(
        "article",
        F.from_json(
            F.col(value), f"struct<{schema}>",
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT},
        ),
    )
    article = F.col("article")
    time = F.try_to_timestamp(article["published_at"])
    missing = [
        F.when(article[name].isNull(), F.lit(f"missing {name}")) for name in _REQUIRED
    ]
    reason = F.coalesce(
        F.when(article.isNull() | article[_CORRUPT].isNotNull(), F.lit("not a JSON record")),
        *missing,
        F.when(time.isNull(), F.lit("bad published_at")),
    )
    return parsed.withColumn("_dlq_reason", reason)


def decoded_articles(decoded: DataFrame) -> DataFrame:
    """Good messages as article rows; the hash is computed again from headline and URL."""
    fields = [F.col(f"article.{f}").alias(f) for f in RAW_ARTICLE_WIRE.fieldNames()]
    good = decoded.filter(F.col("_dlq_reason").isNull()).select(*fields)
    typed = good.withColumn("published_at", F.try_to_timestamp("published_at")).withColumn(
        "content_hash", content_hash(F.col("headline"), F.col("url"))
    )
    return conform(typed, RAW_ARTICLE)


def dead_letters(decoded: DataFrame, value: str = "value") -> DataFrame:
    """Bad messages as they came, with the reason, one row each."""
    return decoded.filter(F.col("_dlq_reason").isNotNull()).select(
        F.col(value).alias("value"), "_dlq_reason"
    )


def split_dead_letters(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    decoded = decode(messages)
    return decoded_articles(decoded), dead_letters(decoded)


def dead_letter_messages(rejected: DataFrame) -> DataFrame:
    """Article rows with `_dlq_reason` as messages for the dead-letter topic."""
    wire = article_dict(rejected).columns
    body = rejected.select(
        "content_hash",
        F.to_json(
            F.struct(
                *[
                    (F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if c == "published_at"
                     else F.col(c)).alias(c)
                    for c in wire
                ],
                "_dlq_reason",
            )
        ).alias("value"),
    )
    return body.select(F.col("content_hash").alias("key"), "value")


def status(error: Column | None = None) -> Column:
    """ok, error (the transport failed) or deserialise_error, for a decoded message."""
    failed = error.isNotNull() if error is not None else F.lit(False)
    return (
        F.when(failed, "error")
        .when(F.col("_dlq_reason").isNotNull(), "deserialise_error")
        .otherwise("ok")
    )


def count_decode_status(messages: DataFrame, error: str | None = None) -> DataFrame:
    decoded = decode(messages)
    own = status(F.col(error) if error else None)
    return decoded.groupBy(own.alias("status")).agg(F.count("*").alias("messages"))


