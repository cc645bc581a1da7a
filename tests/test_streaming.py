import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from test_dedup import greedy
from tickerloom.functions.fingerprint import simhash_value
from tickerloom.operators import rollups as ro
from tickerloom.plans import streams, views
from tickerloom.sources.tables import read_table
from tickerloom.sources.topic import read_message_files
from tickerloom.streaming import jobs

START = datetime(2024, 1, 1)


def message(i, **changes):
    return json.dumps({
        "source": f"s{i % 2}", "headline": f"AAPL headline {i}", "url": f"doc://s/{i}",
        "published_at": (START + timedelta(minutes=7 * i)).isoformat() + "+00:00", **changes,
    })


def drop_file(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def finish(writer, checkpoint):
    query = jobs.start(writer, str(checkpoint))
    query.awaitTermination()
    return query


def lag():
    return F.col("published_at") + F.make_interval(secs=F.lit(5))


def test_enrich_across_restarts_and_replays(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")

    def run(checkpoint="cp"):
        stream = read_message_files(spark, str(inbox), max_files=1)
        writer = jobs.enrich_stream(stream, views.scorer, out, views.STORE_PARAMS, lag())
        return finish(writer, tmp_path / checkpoint)

    drop_file(inbox, "a.txt", [message(i) for i in range(20)] + ["{broken", message(0)])
    drop_file(inbox, "b.txt", [message(i) for i in range(15, 30)] + [message(99, published_at="x")])
    run()
    drop_file(inbox, "c.txt", [message(i) for i in range(28, 35)])
    query = run()
    stored = read_table(spark, f"{out}/results")
    assert stored.count() == 35 and stored.select("article_hash").distinct().count() == 35
    assert stored.filter("tickers[0] = 'AAPL'").count() == 35
    assert spark.read.parquet(f"{out}/dead").count() == 2
    counted = query.lastProgress["observedMetrics"]["consumed"]
    assert json.loads(json.dumps(counted, default=lambda r: r.asDict()))  # ok, deserialise_error
    # A lost checkpoint delivers everything once more: nothing is stored twice.
    run("cp2")
    assert read_table(spark, f"{out}/results").count() == 35

    expected = views.enrich(
        spark.createDataFrame(
            [(f"s{i % 2}", f"AAPL headline {i}", f"doc://s/{i}", START + timedelta(minutes=7 * i)) for i in range(35)],
            "source string, headline string, url string, published_at timestamp",
        ).select("*", F.lit("").alias("body"), F.lit("").alias("author"),
                 F.substring(F.sha2(F.concat("headline", "url"), 256), 1, 16).alias("content_hash"))
    )
    columns = ["article_hash", "ensemble_sentiment", "market_impact", "hedge_score"]
    assert sorted(stored.select(columns).collect()) == sorted(expected.select(columns).collect())


def stored_stream(spark, tmp_path, batches):
    path = str(tmp_path / "results")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(
            rows, "article_hash string, published_at timestamp, tickers array<string>, ensemble_sentiment string"
        ).select(
            "*", F.lit("s").alias("source"),
            *[F.lit(0.25 * (i + 1)).alias(c) for c in ro.AVERAGES.values()],
        )
        df.coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.read.parquet(path), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


BATCHES = [
    [("a", START, ["KO"], "positive"), ("b", START + timedelta(minutes=5), ["KO", "GS"], "negative")],
    [("c", START + timedelta(minutes=59), ["KO"], "neutral"), ("d", START + timedelta(minutes=61), [], "positive")],
    [("e", START + timedelta(minutes=30), ["GS"], "negative")],
]


def test_hourly_rollup_is_kept_current(spark, tmp_path):
    stored, stream = stored_stream(spark, tmp_path, BATCHES)
    log = str(tmp_path / "log")
    finish(jobs.hourly_stream(stream, log), tmp_path / "cp")
    key = ["bucket", "source", "ensemble_sentiment", "article_count", "avg_confidence"]
    got = jobs.read_hourly(spark, log).select(key).collect()
    assert sorted(got) == sorted(ro.hourly_rollup(stored).select(key).collect())


def test_ticker_state_adds_up_and_expires(spark, tmp_path):
    _, stream = stored_stream(spark, tmp_path, BATCHES)
    now = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")))
    finish(jobs.ticker_state_stream(stream, str(tmp_path / "state"), now), tmp_path / "cp")
    state = {r.ticker: r for r in jobs.read_latest(spark, str(tmp_path / "state")).collect()}
    assert (state["KO"].article_count, state["GS"].article_count) == (3, 2)
    assert state["KO"].positive_count == 1 and state["GS"].negative_pct == 1.0
    before = jobs.read_latest(spark, str(tmp_path / "state"))
    changes = before.filter("ticker = 'GS'")
    later = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:05:01")))
    expired = jobs.merge_ticker_state(before, changes, later, 300).collect()
    assert [(r.ticker, r.article_count) for r in expired] == [("GS", 2)]


def test_latest_cache(spark, tmp_path):
    _, stream = stored_stream(spark, tmp_path, BATCHES)
    path = str(tmp_path / "cache")
    finish(jobs.latest_stream(stream, path, views.Params(latest_cap=3)), tmp_path / "cp")
    cache = jobs.read_latest(spark, path)
    assert {r.article_hash for r in cache.collect()} == {"d", "c", "e"}
    alive = jobs.unexpired(cache, START + timedelta(minutes=90), 1_900, "published_at")
    assert {r.article_hash for r in alive.collect()} == {"c", "d"}


def test_near_dedup_over_batches_equals_one_pass(spark, tmp_path):
    base = "Bank shares rise after record results while bond yields fall across the curve today"
    texts = [base, "Something else entirely about oil", base + "!", base.upper(), base + " x",
             "Oil prices climb again", base, "Oil prices climb again.", "New words only here"]
    folder = str(tmp_path / "in")
    for start in range(0, len(texts), 3):
        rows = [(i, t, START + timedelta(seconds=i), str(hash(t))) for i, t in enumerate(texts)][start:start + 3]
        spark.createDataFrame(rows, "ordinal int, headline string, ingest_ts timestamp, content_hash string") \
            .coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    finish(jobs.dedup_near_stream(stream, out), tmp_path / "cp")
    got = {r.ordinal for r in spark.read.parquet(f"{out}/kept").collect()}
    assert got == greedy([simhash_value(t) for t in texts])


def arrivals(spark, tmp_path, rows, batches):
    """(hours, headline) in arrival order as a stream of so many micro-batches."""
    folder = str(tmp_path / f"in{batches}")
    timed = [(i, t, START + timedelta(hours=h), str(hash(t))) for i, (h, t) in enumerate(rows)]
    step = -(-len(timed) // batches)
    for at in range(0, len(timed), step):
        spark.createDataFrame(timed[at:at + step], "ordinal int, headline string, ingest_ts timestamp, content_hash string") \
            .coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_window_does_not_depend_on_batches(spark, tmp_path):
    one, two = "Bank shares rise after record results", "Something else entirely about oil"
    rows = [(0, one), (1, one), (20, two), (23, one), (24, one), (30, one), (43, two), (44, two),
            (47, one), (48, one), (49, two), (200, one), (201, one)]
    expected, until = set(), {}
    for i, (hour, text) in enumerate(rows):
        if hour >= until.get(text, 0):
            expected.add(i)
            until[text] = hour + 24
    for job in (jobs.dedup_exact_stream, jobs.dedup_near_stream):
        for batches in (1, 4):
            out = str(tmp_path / f"{job.__name__}{batches}")
            finish(job(arrivals(spark, tmp_path / job.__name__, rows, batches), out), tmp_path / f"cp-{job.__name__}{batches}")
            got = {r.ordinal for r in spark.read.parquet(f"{out}/kept").collect()}
            assert got == expected, (job.__name__, batches)


def test_a_given_table_may_be_a_file_or_a_folder_of_files(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("doc_id"), F.concat(F.lit("AAPL beats "), "id").alias("text"))
    rows = rows.withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).withColumn("n_chars", F.lit(9))
    rows.repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "file").mkdir()
    part = next((tmp_path / "written").glob("part-*.parquet"))
    (tmp_path / "file" / "documents.parquet").write_bytes(part.read_bytes())
    for kind in ("folder", "file"):
        stream = streams._stream(spark, f"{tmp_path}/{kind}", "documents")
        query = stream.writeStream.format("memory").queryName(f"read_{kind}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(f"read_{kind}").count() == 20
