"""Landed payloads built from the given documents, one payload per document or per feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.plans.views import articles, doc_id
from tickerloom.sources.topic import to_topic

# What XML 1.0 cannot carry.
_NOT_XML = r"[\x00-\x08\x0b\x0c\x0e-\x1f\uFFFE\uFFFF]"
_FEED_SIZE = 25


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = articles(spark, sf_dir).withColumn("id", doc_id())
    return found.withColumn("payload_id", F.lpad(F.col("id").cast("string"), 12, "0"))


def _payload(rows: DataFrame, payload: Column) -> DataFrame:
    return rows.select(
        "payload_id", payload.alias("payload"), F.col("published_at").alias("ingest_ts")
    )


def newsapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the article, a placeholder, a blank title, and a second form of the article."""
    rows = _numbered(spark, sf_dir)
    missing = F.lit(None).cast("string")
    time = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def item(name: Column, title: Column, at: Column, content: Column, description: Column, author: Column) -> Column:
        return F.struct(
            F.struct(name.alias("name")).alias("source"), title.alias("title"),
            F.col("url").alias("url"), at.alias("publishedAt"), content.alias("content"),
            description.alias("description"), author.alias("author"),
        )

    items = F.array(
        item(F.col("source"), F.concat(F.lit("  "), "headline", F.lit(" ")), time, F.lit(""),
             F.col("body"), F.lit("desk")),
        item(F.col("source"), F.lit("[Removed]"), time, missing, missing, missing),
        item(F.col("source"), F.lit("   "), time, missing, missing, missing),
        item(missing, F.concat(F.lit("Update: "), "body"),
             F.when(F.col("id") % 7 == 0, "soon").otherwise(time), F.col("body"), missing, missing),
    )
    return _payload(rows, F.to_json(F.struct(items.alias("articles"))))


def alpha_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _numbered(spark, sf_dir)
    time = F.date_format("published_at", "yyyyMMdd'T'HHmmss")
    items = F.array(
        F.struct(
            F.col("headline").alias("title"), F.col("url").alias("url"),
            F.when(F.col("id") % 5 == 0, "not a time").otherwise(time).alias("time_published"),
            F.col("body").alias("summary"), F.col("source").alias("source"),
            F.when(F.col("id") % 2 == 0, F.array(F.lit("first"), F.lit("second"))).otherwise(
                F.array().cast("array<string>")
            ).alias("authors"),
        ),
        F.struct(
            F.lit(" ").alias("title"), F.col("url").alias("url"), time.alias("time_published"),
            F.col("body").alias("summary"), F.col("source").alias("source"),
            F.array().cast("array<string>").alias("authors"),
        ),
    )
    return _payload(rows, F.to_json(F.struct(items.alias("feed"))))


def rss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds of 25 documents each, so that the cap of a feed shows."""
    def text(column: str) -> Column:
        clean = F.regexp_replace(column, _NOT_XML, " ")
        for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            clean = F.replace(clean, F.lit(raw), F.lit(escaped))
        return clean

    rows = _numbered(spark, sf_dir).withColumn("feed", F.floor(F.col("id") / _FEED_SIZE))
    time = F.date_format("published_at", "E, d MMM yyyy HH:mm:ss Z")
    item = F.concat(
        F.lit("<item><title>"), text("headline"), F.lit("</title><link>"), text("url"),
        F.lit("</link><summary>"), text("body"), F.lit("</summary>"),
        F.when(
            F.col("id") % 3 == 0, F.concat(F.lit("<pubDate>"), time, F.lit("</pubDate>"))
        ).otherwise(F.lit("")),
        F.lit("</item>"),
    )
    feeds = rows.groupBy("feed").agg(
        F.array_sort(F.collect_list(F.struct("id", item.alias("item")))).alias("items"),
        F.max("published_at").alias("published_at"),
    )
    body = F.concat(
        F.lit("<rss><channel>"),
        F.when(
            F.col("feed") % 2 == 0,
            F.concat(F.lit("<title>Feed "), F.col("feed").cast("string"), F.lit("</title>")),
        ).otherwise(F.lit("")),
        F.concat_ws("", F.transform("items", lambda i: i["item"])),
        F.lit("</channel></rss>"),
    )
    keyed = feeds.withColumn("payload_id", F.lpad(F.col("feed").cast("string"), 12, "0"))
    return _payload(keyed, body).withColumn(
        "feed_url", F.concat(F.lit("http://feeds/"), F.col("payload_id"))
    )


def damaged(sent: DataFrame) -> DataFrame:
    """Messages with an id; some cut short, some without a URL, some with a bad time."""
    ix = F.regexp_extract("value", r'"url":"doc://[^/"]*/(\d+)"', 1).cast("long")
    numbered = sent.withColumn("id", ix)
    broken = (
        F.when(F.col("id") % 11 == 0, F.expr("substr(value, 1, length(value) - 9)"))
        .when(F.col("id") % 13 == 0, F.regexp_replace("value", '"url":"[^"]*",', ""))
        .when(
            F.col("id") % 17 == 0,
            F.regexp_replace("value", '"published_at":"[^"]*"', '"published_at":"soon"'),
        )
        .otherwise(F.col("value"))
    )
    return numbered.select("id", "key", broken.alias("value"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged topic messages; some also report a transport error."""
    sent = damaged(to_topic(articles(spark, sf_dir)))
    return sent.withColumn("error", F.when(F.col("id") % 19 == 0, "transport"))
