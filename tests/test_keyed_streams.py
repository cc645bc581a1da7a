"""Keyed state: windows across restarts, bounded state, records that expire, and the stored band index."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickerloom.operators.dedup import near_pairs
from tickerloom.params import Params
from tickerloom.streaming import bands, jobs, keyed

START = datetime(2024, 1, 1)
HOUR = timedelta(hours=1)


def finish(writer, checkpoint):
    query = jobs.start(writer, str(checkpoint))
    query.awaitTermination()
    return query


def feed(spark, folder, rows, schema, job, checkpoint, batches):
    """A restart for each batch; the finished runs."""
    runs = []
    for batch in batches:
        spark.createDataFrame(rows[batch], schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        runs.append(finish(job(stream), checkpoint))
    return runs


def test_window_across_restarts_and_bounded_state(spark, tmp_path):
    schema = "ordinal long, content_hash string, ingest_ts timestamp"
    # Each hour 20 hashes of its own, and one that comes every 7 minutes.
    rows = [(100 * h + i, f"h{h}-{i}", START + h * HOUR) for h in range(100) for i in range(20)]
    rows += [(10_000 + i, "often", START + timedelta(minutes=7 * i)) for i in range(850)]
    rows.sort(key=lambda r: (r[2], r[0]))
    expected, until = set(), {}
    for ordinal, key, at in rows:
        if at >= until.get(key, START):
            expected.add(ordinal)
            until[key] = at + 24 * HOUR
    out = str(tmp_path / "out")
    step = len(rows) // 4 + 1
    batches = [slice(i, i + step) for i in range(0, len(rows), step)]
    runs = feed(spark, str(tmp_path / "in"), rows, schema, lambda s: jobs.dedup_exact_stream(s, out), tmp_path / "cp", batches)
    kept = spark.read.parquet(f"{out}/kept")
    assert {r.ordinal for r in kept.collect()} == expected and kept.count() == len(expected)
    # One value and one timer for every hash of one window at most, with the watermark's hour to spare.
    assert len({r[1] for r in rows}) == 2_001
    for run in runs:
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4 * 20 * 26


def records(rows, ttl, now):
    out = {}
    for at, tickers, sentiment in sorted(rows):
        for t in tickers:
            held = out.get(t)
            if held is None or at - held["at"] > ttl:
                held = out[t] = {"n": 0, "positive": 0, "negative": 0, "neutral": 0}
            held["n"] += 1
            held[sentiment] += 1
            held["at"] = at
    return {(t, *h.values()) for t, h in out.items() if now - h["at"] <= ttl}


def test_ticker_records_expire(spark, tmp_path):
    minute = timedelta(minutes=1)
    plan = {"KO": [0, 3, 6, 12, 15, 20, 40, 41, 90, 91], "GS": [1, 2, 50, 55, 60, 88], "BTC": [2, 30], "XOM": [5, 10, 15]}
    names = ("positive", "negative", "neutral")
    rows = sorted((START + m * minute, [t], names[m % 3]) for t, ms in plan.items() for m in ms)
    schema = "published_at timestamp, tickers array<string>, ensemble_sentiment string"
    ttl, now = 5 * 60, START + 91 * minute
    first = [r for r in rows if r[0] < START + 7 * minute]
    later = [r for r in rows if r[0] >= START + 7 * minute]
    frame = spark.createDataFrame(rows, schema)
    columns = ["ticker", "article_count", "positive_count", "negative_count", "neutral_count", "updated_at"]
    every = keyed.ticker_sessions(frame, ttl)
    fresh = every.filter(F.col("updated_at") >= F.lit(now) - F.make_interval(secs=F.lit(ttl)))
    expected = records(rows, timedelta(seconds=ttl), now)
    assert {tuple(r) for r in fresh.select(columns).collect()} == expected == {
        ("KO", 2, 1, 1, 0, now), ("GS", 1, 0, 1, 0, START + 88 * minute)
    }
    path = str(tmp_path / "initial")
    keyed.ticker_sessions(spark.createDataFrame(first, schema), ttl).write.parquet(path)
    initial, out = spark.read.parquet(path), str(tmp_path / "changes")
    batches = [slice(0, 4), slice(4, 9), slice(9, None)]
    feed(
        spark, str(tmp_path / "in"), later, schema,
        lambda s: jobs.ticker_record_stream(s, out, ttl, initial), tmp_path / "cp", batches,
    )
    changes = spark.read.parquet(out)
    alive = keyed.alive_records(changes, F.lit(now), ttl).select(columns)
    assert {tuple(r) for r in alive.collect()} == expected
    # BTC and XOM fell silent; event time passed them, and their state said so.
    assert {r.ticker for r in changes.filter("expired").collect()} >= {"BTC", "XOM"}
    # KO's counts went on from the stored record: 0, 3 and 6 before, 12 begins anew.
    assert changes.filter("ticker = 'KO' AND batch_id = 0").select(F.max("article_count")).first()[0] <= 3


@pytest.mark.parametrize("hot", [16_384, 1])
def test_stored_bands_find_near_prints(spark, tmp_path, hot):
    import random

    rng = random.Random(7)
    draw = lambda: rng.getrandbits(64) - (1 << 63)
    base = [draw() for _ in range(20)]
    flip = lambda v, n: (v + (1 << 63)) ^ sum(1 << b for b in rng.sample(range(64), n))
    near = [flip(v, n) - (1 << 63) for v in base for n in (0, 1, 3, 4)]
    seen = [(v, START + timedelta(hours=i)) for i, v in enumerate(base)]
    path = str(tmp_path / "bands")
    bands.append_bands(spark.createDataFrame(seen, "fp long, ts timestamp"), path, 0, "ts")
    # Batches from this one on, and rows before the horizon, are not met.
    bands.append_bands(spark.createDataFrame([(v, START + 99 * HOUR) for v in base], "fp long, ts timestamp"), path, 1, "ts")
    since = F.lit(START + 4 * HOUR)
    asking = spark.createDataFrame([(v,) for v in near], "fp long")
    got = bands.remembered(asking, path, 1, since, "ts", Params(), hot)
    expected = {}
    for v in near:
        for w, at in seen:
            if bin((v ^ w) & ((1 << 64) - 1)).count("1") <= 3 and at > START + 4 * HOUR:
                expected[v] = max(expected.get(v, at), at)
    assert {r.fp: r.newest for r in got.collect()} == expected and len(expected) >= 45
    assert bands.remembered(asking, str(tmp_path / "none"), 1, since, "ts") is None
    pairs = near_pairs(asking.distinct(), spark.createDataFrame([(v,) for v in base], "fp long"))
    assert {r.fp_a for r in pairs.collect()} >= set(expected)
