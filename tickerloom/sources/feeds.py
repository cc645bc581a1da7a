"""Landed payloads of three kinds of news source to article rows.

Each reader takes a table with one payload per row (`payload` text; `payload_id`, a sortable
arrival key; `ingest_ts`), so a folder of landed files, a topic or a table serve alike. Payloads
are parsed and exploded in place: no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.text import content_hash, strip
from tickerloom.operators.dedup import dedup
from tickerloom.params import DEFAULTS, Params

NEWSAPI = (
    "articles array<struct<source:struct<name:string>,title:string,url:string,"
    "publishedAt:string,content:string,description:string,author:string>>"
)
ALPHA_VANTAGE = (
    "feed array<struct<title:string,url:string,time_published:string,summary:string,"
    "source:string,authors:array<string>>>"
)
RSS = (
    "channel struct<title:string,item:array<struct<title:string,link:string,"
    "description:string,summary:string,author:string,pubDate:string,published:string,"
    "updated:string>>>"
)

# The placeholder headline and the time formats of the sources.
REMOVED = "[Removed]"
COMPACT_TIME = "yyyyMMdd'T'HHmmss"
RSS_TIME = "d MMM yyyy HH:mm:ss Z"

# Source kinds in the order in which a fetch asks them.
RANK = {"newsapi": 0, "rss": 1, "alpha_vantage": 2}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file; the file name is the arrival key."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("payload_id"),
        F.col("content").cast("string").alias("payload"),
        F.col("modificationTime").alias("ingest_ts"),
    )


def _filled(value: Column, default: str = "") -> Column:
    """The value, or the default where it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def _articles(
    items: DataFrame, kind: str, source: Column, headline: Column, url: Column,
    published_at: Column, body: Column, author: Column,
) -> DataFrame:
    named = items.select(
        F.lit(kind).alias("source_kind"), F.lit(RANK[kind]).alias("source_rank"),
        "payload_id", "pos", source.alias("source"), strip(headline).alias("headline"),
        F.coalesce(url, F.lit("")).alias("url"), published_at.alias("published_at"),
        body.alias("body"), author.alias("author"),
    )
    kept = named.filter((F.col("headline") != "") & (F.col("headline") != REMOVED))
    return kept.withColumn("content_hash", content_hash(F.col("headline"), F.col("url")))


def normalize_newsapi(payloads: DataFrame) -> DataFrame:
    """`articles[]` of JSON payloads. Rows without a usable headline go; a bad time stays null."""
    items = payloads.select(
        "payload_id", "ingest_ts",
        F.posexplode(F.from_json("payload", NEWSAPI).getField("articles")),
    )
    c = F.col("col")
    return _articles(
        items, "newsapi",
        source=F.concat(F.lit("newsapi:"), F.coalesce(c["source"]["name"], F.lit("unknown"))),
        headline=c["title"], url=c["url"],
        published_at=F.try_to_timestamp(c["publishedAt"]),
        body=F.coalesce(
            F.nullif(c["content"], F.lit("")), F.nullif(c["description"], F.lit("")), F.lit("")
        ),
        author=_filled(c["author"]),
    )


def normalize_rss(payloads: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Items of RSS payloads: all, or with `feed_item_cap` the first of each feed document.

    `payloads` may carry `feed_url`, used where a feed has no title.
    """
    feed_url = F.col("feed_url") if "feed_url" in payloads.columns else F.col("payload_id")
    parsed = payloads.select(
        "payload_id", "ingest_ts", feed_url.alias("feed_url"),
        F.from_xml(F.col("payload"), RSS).getField("channel").alias("channel"),
    )
    listed = F.col("channel.item")
    if params.feed_item_cap is not None:
        listed = F.slice(listed, 1, params.feed_item_cap)
    items = parsed.select(
        "payload_id", "ingest_ts",
        F.coalesce("channel.title", "feed_url").alias("feed"), F.posexplode(listed),
    )
    c = F.col("col")

    def when(text: Column) -> Column:
        # The weekday says nothing new, and the zone may be a name.
        plain = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]+,\s*", ""), "(GMT|UTC|UT)$", "+0000")
        return F.coalesce(F.try_to_timestamp(plain, F.lit(RSS_TIME)), F.try_to_timestamp(text))

    return _articles(
        items, "rss",
        source=F.concat(F.lit("rss:"), F.col("feed")),
        headline=F.coalesce(c["title"], F.lit("")), url=c["link"],
        published_at=F.coalesce(
            when(c["published"]), when(c["pubDate"]), when(c["updated"]), F.col("ingest_ts")
        ),
        body=F.coalesce(c["summary"], c["description"], F.lit("")),
        author=F.coalesce(c["author"], F.lit("")),
    )


def normalize_alpha_vantage(payloads: DataFrame) -> DataFrame:
    """`feed[]` of JSON payloads; an unreadable time becomes the ingestion time."""
    items = payloads.select(
        "payload_id", "ingest_ts",
        F.posexplode(F.from_json("payload", ALPHA_VANTAGE).getField("feed")),
    )
    c = F.col("col")
    return _articles(
        items, "alpha_vantage",
        source=F.concat(F.lit("av:"), F.coalesce(c["source"], F.lit("unknown"))),
        headline=F.coalesce(c["title"], F.lit("")), url=c["url"],
        published_at=F.coalesce(
            F.try_to_timestamp(c["time_published"], F.lit(COMPACT_TIME)), F.col("ingest_ts")
        ),
        body=F.coalesce(c["summary"], F.lit("")),
        author=F.coalesce(F.try_element_at(c["authors"], F.lit(1)), F.lit("")),
    )


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """The sources appended, with `arrival`: source order, payload, position in the payload."""
    merged = sources[0]
    for other in sources[1:]:
        merged = merged.unionByName(other)
    return merged.withColumn("arrival", F.struct("source_rank", "payload_id", "pos"))


def fetch_unique(sources: Sequence[DataFrame], params: Params = DEFAULTS) -> DataFrame:
    """All articles of the sources that survive exact and near de-duplication."""
    return dedup(union_sources(sources), params, arrival="arrival")


def fetch_all(sources: Sequence[DataFrame], params: Params = DEFAULTS) -> DataFrame:
    """Unique articles, newest first: all, or with `fetch_cap` so many."""
    ordered = fetch_unique(sources, params).orderBy(F.col("published_at").desc_nulls_last(), "arrival")
    return ordered if params.fetch_cap is None else ordered.limit(params.fetch_cap)


def fetch_stats(fetched: DataFrame, kept: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Per source kind: rows fetched, rows removed as duplicates, failed payloads, yield rate.

    The tables are counted first and the few counts combined, instead of joining the rows.
    """
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("source_kind").agg(F.count("*").alias("n")).select(
            "source_kind", F.lit(name).alias("what"), "n"
        )

    counts = counted(fetched, "fetched").unionByName(counted(kept, "kept"))
    if errors is not None:
        counts = counts.unionByName(counted(errors, "errors"))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("what") == name, F.col("n"))), F.lit(0))

    per_kind = counts.groupBy("source_kind").agg(
        total("fetched").alias("fetched"),
        (total("fetched") - total("kept")).alias("deduplicated"),
        total("errors").alias("errors"),
    )
    return per_kind.withColumn(
        "yield_rate",
        F.when(F.col("fetched") == 0, F.lit(0.0)).otherwise(
            (F.col("fetched") - F.col("deduplicated")) / F.col("fetched")
        ),
    )


def failed_payloads(payloads: DataFrame, kind: str) -> DataFrame:
    """Payloads of a kind that do not parse; one error each."""
    parsed = (
        F.from_xml(F.col("payload"), RSS, {"mode": "PERMISSIVE"}).getField("channel")
        if kind == "rss"
        else F.from_json("payload", NEWSAPI).getField("articles")
        if kind == "newsapi"
        else F.from_json("payload", ALPHA_VANTAGE).getField("feed")
    )
    return payloads.filter(parsed.isNull()).select(F.lit(kind).alias("source_kind"), "payload_id")
