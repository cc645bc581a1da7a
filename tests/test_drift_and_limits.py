import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import drift as dr
from tickerloom.operators import limits as li
from tickerloom.params import Params

SCHEMA = (
    "article_hash string, published_at timestamp, ensemble_confidence double, "
    "ensemble_sentiment string, positive_prob double, negative_prob double, neutral_prob double"
)
NOW = datetime(2024, 1, 2)
NAMES = ["positive", "negative", "neutral"]


def rows(n, seed, skew=0.0, at=lambda i: NOW - timedelta(minutes=i)):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.array([1 + skew, 1, 1]), size=n)
    return [
        (f"{rng.integers(1 << 62):016x}", at(i), float(q.max()), NAMES[int(q.argmax())], *map(float, q))
        for i, q in enumerate(p)
    ]


def expected(ref, cur):
    def shares(side):
        h = np.histogram([r[2] for r in side], bins=np.linspace(0, 1, 11))[0] / len(side)
        return h.clip(1e-6)

    r, c = shares(ref), shares(cur)
    psi = ((c - r) * np.log(c / r)).sum()
    rl = np.array([sum(x[3] == s for x in ref) for s in NAMES], float)
    cl = np.array([sum(x[3] == s for x in cur) for s in NAMES], float)
    table = np.vstack([cl, rl / rl.sum() * cl.sum()]).clip(min=1)
    e = table.sum(axis=1, keepdims=True) * table.sum(axis=0) / table.sum()
    p_value = math.exp(-((table - e) ** 2 / e).sum() / 2)
    p = rl / rl.sum() + 1e-9
    q = np.mean([x[4:] for x in cur], axis=0) + 1e-9
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    js = 0.5 * ((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum())
    return psi, js, p_value


def test_report_equals_numpy_and_alerts(spark):
    for skew, drifting in ((0.0, False), (6.0, True)):
        ref, cur = rows(300, 1), rows(200, 2, skew)
        got = dr.drift_report(
            spark.createDataFrame(ref, SCHEMA), spark.createDataFrame(cur, SCHEMA)
        ).first()
        psi, js, p = expected(ref, cur)
        assert got.psi_confidence == pytest.approx(psi, abs=1e-6)
        assert got.js_divergence == pytest.approx(js, abs=1e-6)
        assert got.chi2_pvalue == pytest.approx(p, abs=1e-6)
        assert got.is_drifting == drifting == bool(got.alerts)
        if drifting:
            assert f"PSI={psi:.4f} > 0.2" in got.alerts


def test_check_skips_thin_windows(spark):
    df = spark.createDataFrame(rows(100, 3), SCHEMA)
    full = dr.drift_check(df, NOW).first()
    assert (full.reference_rows, full.current_rows) == (100, 61)
    assert dr.drift_metrics(dr.drift_check(df, NOW)).count() == 3
    own = dr.drift_check(df, NOW, exclude_current=True, min_reference=10).first()
    assert own.reference_rows == 39
    assert dr.drift_check(df, NOW + timedelta(hours=5)).count() == 0
    assert dr.drift_check(df.filter("false"), NOW).count() == 0


@pytest.mark.parametrize("tied", [False, True])
def test_halves(spark, tied):
    # Tied: two thirds of all rows share one moment.
    at = (lambda i: NOW - timedelta(minutes=max(i - 40, 0))) if tied else (
        lambda i: NOW - timedelta(minutes=i)
    )
    data = rows(61, 5, at=at)
    marked = dr.mark_halves(spark.createDataFrame(data, SCHEMA), params=Params(order_buckets=8))
    order = sorted(data, key=lambda r: (-r[1].timestamp(), r[0]))
    got = {r.article_hash for r in marked.filter("side = 'cur'").collect()}
    assert got == {r[0] for r in order[:30]}
    assert dr.drift_split_half(spark.createDataFrame(data[:19], SCHEMA)).count() == 0


def test_psi_band(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.2,), (0.3,)], "x double")
    got = [r.b for r in df.select(dr.psi_band(F.col("x")).alias("b")).collect()]
    assert got == ["stable", "moderate", "moderate", "significant"]


def calls(seed):
    rng = random.Random(seed)
    out, t = [], {c: 0.0 for c in "abc"}
    for i in range(400):
        c = rng.choice("aaab") if i % 3 else "c"
        t[c] += rng.choice([0.0, 0.5, 1, 5, 20, 60.0, 61, 300])
        out.append((i, c, NOW + timedelta(seconds=t[c])))
    return out


def test_limits_equal_brute_force(spark):
    data = calls(1)
    df = spark.createDataFrame(data, "call int, client string, ts timestamp")
    params = Params(rate_limit=3)
    sliding = {r.call: (r.calls_in_window, r.limited) for r in li.sliding(df, "client", "ts", "call", params).collect()}
    idle = {r.call: (r.calls_since_idle, r.limited) for r in li.idle_reset(df, "client", "ts", "call", params).collect()}
    last, count = {}, {}
    for i, c, ts in sorted(data, key=lambda r: (r[2], r[0])):
        n = sum(1 for _, d, at in data if d == c and ts - timedelta(seconds=60) <= at <= ts)
        assert sliding[i] == (n, n > 3)
        expired = c not in last or ts - last[c] > timedelta(seconds=60)
        count[c] = 1 if expired else count[c] + 1
        last[c] = ts
        assert idle[i] == (count[c], count[c] > 3)
