import math

import numpy as np
import pytest

from tickerloom.operators import evaluate as ev
from tickerloom.operators.ordering import quantiles, value_at_rank, with_running_totals
from tickerloom.params import Params
from pyspark.sql import functions as F

SCHEMA = (
    "y_true int, y_pred int, p0 double, p1 double, p2 double, preds array<int>, "
    "uncertainty double, latency_ms double"
)


def samples(n=200, digits=None):
    """The true class leads among three clean scores; the model sees them through noise."""
    rng = np.random.default_rng(7)
    clean = rng.normal(size=(n, 3))
    y_true = clean.argmax(axis=1)
    seen = np.exp(clean + rng.normal(scale=0.8, size=clean.shape))
    proba = seen / seen.sum(axis=1)[:, None]
    if digits:
        proba = proba.round(digits)
    y_pred = proba.argmax(axis=1)
    votes = np.where(rng.random((n, 2)) < 0.7, y_pred[:, None], (y_pred[:, None] + 1) % 3)
    unc, lat = 0.4 * (1 - proba.max(axis=1)), rng.gamma(4, 20, n)
    table = np.column_stack([votes, y_pred]).tolist()
    rows = [
        (*key, *probs, preds, u, l)
        for key, probs, preds, u, l in zip(
            zip(y_true.tolist(), y_pred.tolist()), proba.tolist(), table, unc.tolist(), lat.tolist()
        )
    ]
    return rows, y_true, y_pred, proba, lat


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_auc(hit, score):
    pos, neg = score[hit], score[~hit]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def brute_ap(hit, score):
    total, last = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        chosen = score >= t
        recall = hit[chosen].sum() / hit.sum()
        total += (recall - last) * hit[chosen].mean()
        last = recall
    return total


@pytest.mark.parametrize("digits", [None, 2])
@pytest.mark.parametrize("buckets", [4, 1024])
def test_rank_metrics_equal_brute_force(spark, digits, buckets):
    rows, y_true, _, proba, _ = samples(digits=digits)
    got = ev.rank_metrics(frame(spark, rows), Params(order_buckets=buckets)).collect()
    for r in got:
        k = r.class_ix
        assert r.roc_auc == pytest.approx(brute_auc(y_true == k, proba[:, k]))
        assert r.pr_auc == pytest.approx(brute_ap(y_true == k, proba[:, k]))


def test_report_equals_numpy(spark):
    rows, y_true, y_pred, proba, lat = samples()
    wide = ev.evaluate(frame(spark, rows)).first().asDict()
    n = len(y_true)
    cm = np.zeros((3, 3))
    np.add.at(cm, (y_true, y_pred), 1)
    f1 = [2 * cm[k, k] / (cm[k].sum() + cm[:, k].sum()) for k in range(3)]
    s, c = n, np.trace(cm)
    t, p = cm.sum(axis=1), cm.sum(axis=0)
    mcc = (c * s - t @ p) / math.sqrt((s * s - p @ p) * (s * s - t @ t))
    conf, right = proba.max(axis=1), y_pred == y_true
    edges = np.linspace(0, 1, 16)
    ece = sum(
        m.sum() / n * abs(right[m].mean() - conf[m].mean())
        for lo, hi in zip(edges, edges[1:]) if (m := (conf >= lo) & (conf < hi)).any()
    )
    onehot = np.eye(3)[y_true]
    expected = {
        "n_samples": n, "accuracy": c / n, "macro_f1": np.mean(f1), "micro_f1": c / n,
        "weighted_f1": (np.array(f1) * t).sum() / n, "mcc": mcc,
        "cohen_kappa": (c / n - t @ p / n**2) / (1 - t @ p / n**2), "ece": ece,
        "brier_score": ((onehot - proba) ** 2).mean(),
        "p50_ms": np.percentile(lat, 50), "p95_ms": np.percentile(lat, 95),
        "p99_ms": np.percentile(lat, 99), "positive_support": t[0], "negative_f1": f1[1],
    }
    for name, value in expected.items():
        places = 2 if name.endswith("_ms") else 6
        assert wide[name] == pytest.approx(value, abs=10.0**-places), name
    assert ev.flatten_report(frame(spark, rows)).count() == 15 + 18


def test_calibration_extremes(spark):
    right = [(0, 0, 1.0, 0.0, 0.0, [0, 0, 0], 0.0, 50.0)] * 300
    wrong = [(1, 0, 1.0, 0.0, 0.0, [0, 1, 2], 0.0, 50.0)] * 200
    assert ev.ece(frame(spark, right)).first().ece < 0.05
    assert ev.ece(frame(spark, wrong)).first().ece > 0.5
    rates = ev.rates(frame(spark, right)).first()
    assert rates.brier_score < 0.01 and rates.ensemble_disagreement == 0
    assert ev.rates(frame(spark, wrong)).first().ensemble_disagreement == 1
    half = [(0, 0, 1.0, 0.0, 0.0, [0, i % 2], 0.0, 1.0) for i in range(100)]
    assert ev.rates(frame(spark, half)).first().ensemble_disagreement == pytest.approx(0.5)
    single = [(0, 0, 1.0, 0.0, 0.0, [0], 0.0, 1.0)] * 3
    assert ev.rates(frame(spark, single)).first().ensemble_disagreement == 0
    one_class = {r.class_name: r for r in ev.rank_metrics(frame(spark, right)).collect()}
    assert all(r.roc_auc is None for r in one_class.values())


def test_empty_input_is_an_error(spark):
    with pytest.raises(Exception, match="empty evaluation set"):
        ev.evaluate(frame(spark, [])).collect()


def test_confusion_and_distribution(spark):
    rows, y_true, *_ = samples()
    cells = ev.confusion_matrix(frame(spark, rows)).collect()
    assert len(cells) == 9 and sum(c.n for c in cells) == len(rows)
    shares = [r.share for r in ev.class_metrics(frame(spark, rows)).collect()]
    assert sum(shares) == pytest.approx(1)


def test_reliability_bins_are_closed_on_the_right(spark):
    rows = [(0, 0, p, 1 - p, 0.0, [0], 0.0, 1.0) for p in (0.0, 0.1, 0.10001, 0.5, 1.0)]
    got = {r.bin: r.n for r in ev.reliability(frame(spark, rows)).collect()}
    assert got == {0: 2, 1: 1, 4: 1, 9: 1}


def test_running_totals_and_quantiles(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=400), np.full(300, 0.5), rng.uniform(0, 1e-9, 200)])
    df = spark.createDataFrame([(float(v), i % 2) for i, v in enumerate(values)], "v double, g int")
    distinct = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    for buckets in (2, 16, 1024):
        rows = with_running_totals(distinct, "v", ["n"], by=["g"], buckets=buckets).collect()
        for g in (0, 1):
            own = values[g::2]
            for r in rows:
                if r.g == g:
                    assert r.n_before == (own < r.v).sum() and r.n_total == len(own)
    points = {"lo": 0.0, "q": 0.37, "m": 0.5, "hi": 1.0}
    got = quantiles(df, "v", points, by=["g"], buckets=16).collect()
    for r in got:
        for name, q in points.items():
            assert r[name] == pytest.approx(np.percentile(values[r.g::2], q * 100), abs=1e-12)
    held = value_at_rank(df.select("v"), "v", F.lit(450), descending=False, buckets=16).first()
    assert held.value == np.sort(values)[450] and held.before == (values < held.value).sum()
    empty = spark.createDataFrame([], "v double, n long")
    assert with_running_totals(empty, "v", ["n"]).count() == 0


def test_label_lookup(spark):
    results = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "headline string, y_pred int")
    labels = spark.createDataFrame([("a", "negative"), ("b", "odd")], "headline string, label string")
    got = {r.headline: r.y_true for r in ev.labels_or_prediction(results, labels).collect()}
    assert got == {"a": 1, "b": 2, "c": 2}
