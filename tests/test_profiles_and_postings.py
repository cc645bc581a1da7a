import uuid
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.functions.vocab import SENTIMENTS
from tickerloom.operators import drift as dr
from tickerloom.operators import ordering
from tickerloom.operators import profiles as pr
from tickerloom.operators import results as rs
from tickerloom.operators import rollups as ro
from tickerloom.operators import sketches as sk
from tickerloom.sources import commitlog
from tickerloom.sources import postings as po

NOW = datetime(2024, 2, 3, 12, 17, 5)
POINTS = {"lowest": 0.0, "q1": 0.25, "median": 0.5, "p99": 0.99, "highest": 1.0}
SCHEMA = (
    "article_hash string, published_at timestamp, tickers array<string>, ensemble_sentiment string, "
    "ensemble_confidence double, ensemble_uncertainty double, positive_prob double, negative_prob double, neutral_prob double"
)


@pytest.fixture(scope="module")
def results(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(4_000):
        p = rng.dirichlet([1, 1, 1 + i / 2_000]).tolist()
        names = ["HOT"] if i % 3 == 0 else ["HOT", "HOT", "KO"] if i % 7 == 0 else [f"T{i % 50}"] if i % 5 else []
        confidence = None if i % 97 == 0 else float(max(p))
        sentiment = SENTIMENTS[int(np.argmax(p))] if i % 101 else None
        rows.append((f"{i:016x}", NOW - timedelta(seconds=41 * i), names, sentiment, confidence, 0.1, *p))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("published_date", F.to_date("published_at"))
    return frame.repartition(8).checkpoint()


def place(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def in_batches(results, add, n=3):
    for k in range(n):
        batch = results.filter(F.conv("article_hash", 16, 10).cast("long") % n == k)
        add(batch, k)
        add(batch, k)  # delivered again


def same(a, b, keys):
    a, b = ({tuple(r[k] for k in keys): r for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and a
    for k, r in a.items():
        for name in POINTS:
            assert r[name] == pytest.approx(b[k][name], rel=1e-12), (k, name)


@pytest.mark.parametrize("by", [[], ["ensemble_sentiment"]])
@pytest.mark.parametrize("slack", [None, 0.002])
def test_sketched_quantiles_are_exact(spark, results, tmp_path, by, slack):
    path, size = place(tmp_path), 64
    value = "ensemble_confidence"
    known = results.filter("ensemble_sentiment IS NOT NULL")
    in_batches(known, lambda b, k: sk.add_sketches(b, path, k, value, by, size=size, compact_every=2))
    stored = sk.read_sketches(spark, path)
    assert commitlog.pending(spark, path) < 2
    # With hardly any slack, brackets miss their ranks, and the way without sketches answers.
    got = sk.exact_quantiles(known, stored, value, POINTS, by, size=size, slack=slack)
    same(got, ordering.quantiles(known, value, POINTS, by), by)


def test_sketches_read_few_values_and_approximate(spark, results, tmp_path):
    path, value = place(tmp_path), "ensemble_confidence"
    in_batches(results, lambda b, k: sk.add_sketches(b, path, k, value, size=128))
    stored = sk.read_sketches(spark, path)
    found = sk.approximate_quantiles(stored, POINTS, size=128).first()
    known = np.array([r[0] for r in results.filter(f"{value} IS NOT NULL").select(value).collect()])
    assert found.n_total == len(known)
    for name, q in POINTS.items():
        assert abs((known <= found[name]).mean() - q) < 3 * sk.rank_error(128) + 1 / len(known)
    assert (found.lowest, found.highest) == (known.min(), known.max())


def test_sketches_of_ties_nothing_and_nan(spark, tmp_path):
    frame = spark.createDataFrame(
        [(NOW, 2.0)] * 500 + [(NOW, float("nan")), (NOW, None), (NOW, 3.0)], "published_at timestamp, x double"
    )
    got = sk.exact_quantiles(frame, sk.hourly_sketches(frame, "x"), "x", POINTS).first()
    assert [got[n] for n in POINTS] == [2.0, 2.0, 2.0, 2.0, 3.0]
    none = frame.filter("false")
    assert sk.exact_quantiles(none, sk.hourly_sketches(none, "x"), "x", POINTS).count() == 0


@pytest.mark.parametrize("as_of", [NOW, NOW.replace(minute=0, second=0), NOW - timedelta(hours=30), NOW + timedelta(hours=5)])
def test_drift_from_profiles_equals_drift_from_rows(spark, results, tmp_path, as_of):
    path = place(tmp_path)
    in_batches(results, lambda b, k: pr.add_profiles(b, path, k, compact_every=2))
    stored = pr.read_profiles(spark, path)
    assert stored.count() == results.select(F.date_trunc("hour", "published_at")).distinct().count()
    assert pr.drift_check(stored, results, as_of).collect() == dr.drift_check(results, as_of).collect()


def test_drift_of_every_hour(spark, results):
    # A row at the very end of an hour counts to the next one here, so none may lie there.
    moved = results.filter("minute(published_at) > 0 OR second(published_at) > 0")
    stored = pr.hourly_profiles(moved.filter("hour(published_at) <> 5"))
    found = {r.timestamp: r for r in pr.drift_hourly(stored).collect()}
    assert len(found) > 30
    for end in sorted(found)[3::14]:
        until = moved.filter("hour(published_at) <> 5").filter(F.col("published_at") < F.lit(end))
        assert dr.drift_check(until, end).first() == found[end]


def test_postings_give_the_rows_of_a_ticker(spark, results, tmp_path):
    path = place(tmp_path)
    in_batches(results, lambda b, k: po.add_postings(b, path, k, slots=8, compact_every=2))
    stored = po.read_postings(spark, path)
    assert stored.count() == results.select(F.explode(F.array_distinct("tickers"))).count()
    for ticker in ("hot", "ko", "T3", "none"):
        own = po.of_ticker(stored, ticker, slots=8)
        assert ro.ticker_summary(own, ticker, NOW, 48).collect() == ro.ticker_summary(results, ticker, NOW, 48).collect()
        got = po.by_ticker(stored, results, ticker, NOW, 24, slots=8).select("article_hash").collect()
        assert sorted(got) == sorted(rs.by_ticker(results, ticker, NOW, 24).select("article_hash").collect())


def test_postings_open_one_slot_of_the_days_asked_for(spark, results, tmp_path):
    path = place(tmp_path)
    po.add_postings(results, path, 0, slots=8)
    stored = po.read_postings(spark, path)
    found = rs.since(po.of_ticker(stored, "KO", slots=8), NOW, 10)
    files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert found.count() and len({f.split("slot=")[1].split("/")[0] for f in files}) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("PartitionFilters"):]
    assert "slot" in scan.split("]")[0] and "published_date" in scan.split("]")[0] and "EqualTo(ticker,KO)" in scan


def test_postings_of_nothing(spark, results, tmp_path):
    path = place(tmp_path)
    assert po.read_postings(spark, path) is None
    po.add_postings(results.filter("false"), path, 0)
    assert po.of_ticker(po.read_postings(spark, path), "KO").count() == 0
