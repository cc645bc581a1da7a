import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import results as rs
from tickerloom.params import Params
from tickerloom.plans import views
from tickerloom.schemas import RAW_ARTICLE_WIRE, SENTIMENT_RESULT, conform
from tickerloom.sources import feeds, tables, topic

INGEST = datetime(2024, 3, 1)


def payloads(spark, *texts):
    rows = [(f"{i:03}", t, INGEST) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "payload_id string, payload string, ingest_ts timestamp")


def newsapi(*items):
    return json.dumps({"articles": list(items)})


def item(title, url="u", at="2024-02-01T10:00:00Z", **more):
    return {"title": title, "url": url, "publishedAt": at, "source": {"name": "desk"}, **more}


def test_newsapi(spark):
    text = newsapi(
        item(" Spaced ", content="", description="d", author=None),
        item("[Removed]"), item(""), item("   "), item(None),
        {"title": "No name", "publishedAt": "bad"},
    )
    got = feeds.normalize_newsapi(payloads(spark, text, "not json")).orderBy("pos").collect()
    assert [(r.headline, r.source, r.body, r.author, r.pos) for r in got] == [
        ("Spaced", "newsapi:desk", "d", "", 0), ("No name", "newsapi:unknown", "", "", 5)
    ]
    assert got[0].published_at == datetime(2024, 2, 1, 10) and got[1].published_at is None
    assert got[1].url == ""
    assert feeds.failed_payloads(payloads(spark, text, "not json"), "newsapi").count() == 1


def test_alpha_vantage(spark):
    text = json.dumps({"feed": [
        {"title": "T", "url": "u", "time_published": "20240201T101112", "summary": "s",
         "source": "x", "authors": ["first", "second"]},
        {"title": "Late", "time_published": "soon", "authors": []}, {"title": " "},
    ]})
    a, b = feeds.normalize_alpha_vantage(payloads(spark, text)).orderBy("pos").collect()
    assert (a.source, a.author, a.published_at) == ("av:x", "first", datetime(2024, 2, 1, 10, 11, 12))
    assert (b.source, b.author, b.published_at) == ("av:unknown", "", INGEST)


def test_rss_caps_a_feed_and_reads_times(spark):
    def entry(i, extra=""):
        return f"<item><title> H{i} </title><link>l{i}</link>{extra}</item>"

    first = "".join(entry(i) for i in range(30))
    second = (
        entry(0, "<pubDate>Thu, 01 Feb 2024 10:00:00 GMT</pubDate><author>a</author>")
        + entry(1, "<updated>2024-02-02T00:00:00Z</updated><description>d</description>")
        + "<item><title> </title></item>"
    )
    docs = payloads(
        spark, f"<rss><channel><title>Feed</title>{first}</channel></rss>",
        f"<rss><channel>{second}</channel></rss>",
    ).withColumn("feed_url", F.lit("http://f"))
    every = feeds.normalize_rss(docs).orderBy("payload_id", "pos").collect()
    assert [r.headline for r in every[:30]] == [f"H{i}" for i in range(30)] and len(every) == 32
    got = feeds.normalize_rss(docs, Params(feed_item_cap=20)).orderBy("payload_id", "pos").collect()
    assert [r.headline for r in got[:20]] == [f"H{i}" for i in range(20)]
    a, b = got[20:]
    assert (a.source, a.published_at, a.author) == ("rss:http://f", datetime(2024, 2, 1, 10), "a")
    assert (b.published_at, b.body) == (datetime(2024, 2, 2), "d")
    assert got[0].source == "rss:Feed" and got[0].published_at == INGEST


def test_fetch_all_and_stats(spark):
    long = "Bank shares rise after record results while bond yields fall across the curve"
    api = payloads(spark, newsapi(item(long, at="2024-02-01T00:00:00Z"), item("Other words here", at="2024-02-03T00:00:00Z")))
    av = payloads(spark, json.dumps({"feed": [
        {"title": long, "url": "u", "time_published": "20240205T000000"},
        {"title": long + "!", "url": "v", "time_published": "20240206T000000"},
        {"title": "Entirely different news", "url": "w", "time_published": "20240202T000000"},
    ]}))
    sources = [feeds.normalize_newsapi(api), feeds.normalize_alpha_vantage(av)]
    got = feeds.fetch_all(sources).collect()
    assert [r.headline for r in got] == ["Other words here", "Entirely different news", long]
    assert got[2].source_kind == "newsapi"
    assert [r.headline for r in feeds.fetch_all(sources, Params(fetch_cap=1)).collect()] == ["Other words here"]
    stats = feeds.fetch_stats(feeds.union_sources(sources), feeds.fetch_unique(sources))
    by_kind = {r.source_kind: r for r in stats.collect()}
    assert (by_kind["newsapi"].fetched, by_kind["newsapi"].deduplicated) == (2, 0)
    assert by_kind["alpha_vantage"].yield_rate == pytest.approx(1 / 3)


def article(spark):
    return spark.createDataFrame(
        [("s", "h", "u", datetime(2024, 1, 1, 1, 2, 3), "b", "a", "x" * 16)],
        "source string, headline string, url string, published_at timestamp, body string, "
        "author string, content_hash string",
    )


def test_topic_round_trip(spark):
    sent = topic.to_topic(article(spark))
    message = json.loads(sent.first().value)
    assert list(message) == RAW_ARTICLE_WIRE.fieldNames()
    assert datetime.fromisoformat(message["published_at"]).replace(tzinfo=None) == datetime(2024, 1, 1, 1, 2, 3)
    good, bad = topic.split_dead_letters(sent)
    row = good.first()
    assert (row.headline, row.body, row.published_at) == ("h", "b", datetime(2024, 1, 1, 1, 2, 3))
    assert bad.count() == 0


def test_dead_letters_and_status(spark):
    base = {"source": "s", "headline": "h", "url": "u", "published_at": "2024-01-01T00:00:00+00:00"}
    values = [
        json.dumps(base), json.dumps({**base, "published_at": "x"}), "{", "[]",
        json.dumps({k: v for k, v in base.items() if k != "url"}),
    ]
    df = spark.createDataFrame([(v, None) for v in values] + [(values[0], "down")], "value string, error string")
    good, bad = topic.split_dead_letters(df)
    assert good.first().body == "" and good.first().author == ""
    reasons = sorted(r._dlq_reason for r in bad.collect())
    assert reasons == sorted(["bad published_at", "not a JSON record", "missing url", "not a JSON record"]) or len(reasons) == 4
    counts = {r.status: r.messages for r in topic.count_decode_status(df, "error").collect()}
    assert counts == {"ok": 1, "error": 1, "deserialise_error": 4}
    rejected = article(spark).withColumn("_dlq_reason", F.lit("why"))
    assert json.loads(topic.dead_letter_messages(rejected).first().value)["_dlq_reason"] == "why"


def result_rows(spark, n, day=1):
    base = spark.range(n).select(
        F.format_string("%016x", "id").alias("article_hash"), F.lit("h").alias("headline"),
        F.concat(F.lit("doc://s/"), F.col("id").cast("string")).alias("url"), F.lit("s").alias("source"),
        F.expr(f"timestamp'2024-01-0{day} 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("published_at"),
        F.lit("positive").alias("ensemble_sentiment"), F.lit(0.5).alias("ensemble_confidence"),
        F.array(F.lit("KO")).alias("tickers"),
    )
    return conform(base, SENTIMENT_RESULT)


def test_insert_if_absent(spark, tmp_path):
    path = str(tmp_path / "results")
    assert tables.read_table(spark, path) is None
    batch = result_rows(spark, 30)
    tables.write_results(batch.unionByName(batch), path)
    tables.write_results(batch, path)
    later = result_rows(spark, 40, day=3).withColumn("headline", F.lit("later"))
    tables.write_results(later, path)
    stored = tables.read_table(spark, path)
    assert stored.count() == 40 and stored.filter("headline = 'later'").count() == 10
    assert stored.filter("tickers[0] = 'KO' AND has_negation = false").count() == 40


def test_partition_pruning(spark, tmp_path):
    path = str(tmp_path / "results")
    tables.write_results(result_rows(spark, 60), path)
    stored = tables.read_table(spark, path)
    asked = rs.recent(stored, datetime(2024, 1, 3, 11), 2, 10)
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "published_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "GreaterThanOrEqual(published_at" in plan
    assert "TakeOrderedAndProject" in plan
    assert asked.count() == 3


def test_text_store_round_trip(spark):
    df = result_rows(spark, 3)
    back = tables.restore_from_text_store(tables.flatten_for_text_store(df))
    assert back.select("tickers", "published_at", "has_negation").collect() == df.select(
        "tickers", "published_at", "has_negation").collect()
    empty = tables.flatten_for_text_store(df).withColumn("tickers", F.lit(None).cast("string"))
    assert tables.restore_from_text_store(empty).first().tickers == []


def test_result_dict_rounds_and_counts(spark):
    row = spark.createDataFrame(
        [("a", 0.87654321, 0.02, [("m", "positive", 0.88, 0.07, 0.05, 42.0)])],
        "article_hash string, ensemble_confidence double, hedge_score double, model_predictions "
        "array<struct<model_name:string,sentiment:string,positive_prob:double,negative_prob:double,"
        "neutral_prob:double,latency_ms:double>>",
    )
    got = rs.result_dict(conform(row, SENTIMENT_RESULT)).first()
    assert (got.ensemble_confidence, got.hedge_score, got.model_count) == (0.8765, 0.02, 1)
    assert got.market_impact == "unknown" and got.is_uncertain is False


def test_request_bounds(spark):
    df = result_rows(spark, 1)
    for call in (
        lambda: rs.by_ticker(df, "KO", INGEST, 169), lambda: rs.recent(df, INGEST, 721),
        lambda: rs.latest_n(df, 0), lambda: rs.latest_or_recent(df, df, INGEST, 501),
    ):
        with pytest.raises(ValueError):
            call()


def test_documents_are_read_whole(spark):
    docs = spark.createDataFrame([(5, "s", "x" * 5000)], "doc_id long, source string, text string")
    assert len(views.as_articles(docs).first().headline) > 5000
