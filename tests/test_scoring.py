import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import models as mo
from tickerloom.operators import scoring as sc
from tickerloom.params import Params
from tickerloom.plans import toymodels as toy

SCORES = "article_hash string, model_ix int, positive_prob double, negative_prob double, neutral_prob double, latency_ms double"


def inputs(spark, n=40, passes=10, seed=1):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet(np.ones(3), size=(n, 3))
    mc = rng.dirichlet(np.ones(3), size=(n, passes))
    scores = spark.createDataFrame(
        [(f"a{i}", m, *map(float, p[i, m]), 1.0) for i in range(n) for m in range(3)], SCORES
    )
    drops = spark.createDataFrame(
        [(f"a{i}", t, *map(float, mc[i, t])) for i in range(n) for t in range(passes)],
        "article_hash string, pass int, p0 double, p1 double, p2 double",
    )
    return p, mc, scores, drops


@pytest.mark.parametrize("temperature", [1.0, 1.7])
def test_predict_equals_numpy(spark, temperature):
    p, mc, scores, drops = inputs(spark)
    params = Params(temperature=temperature, uncertainty_threshold=0.98)
    average = (p * np.array(params.weights)[None, :, None]).sum(axis=1)
    logits = np.log(average + 1e-9) / temperature
    scaled = np.exp(logits - logits.max(axis=1, keepdims=True))
    scaled /= scaled.sum(axis=1, keepdims=True)
    mean = mc.mean(axis=1)
    entropy = -(mean * np.log(mean)).sum(axis=1) / math.log(3)
    # A redelivered score row must change nothing.
    twice = scores.unionByName(scores.filter("model_ix = 1"))
    names = ["positive", "negative", "neutral"]
    for r in sc.predict(twice, drops, params).collect():
        i = int(r.article_hash[1:])
        assert [r.positive_prob, r.negative_prob, r.neutral_prob] == pytest.approx(list(scaled[i]))
        assert r.ensemble_sentiment == names[scaled[i].argmax()]
        assert r.ensemble_confidence == pytest.approx(scaled[i].max())
        assert r.ensemble_uncertainty == pytest.approx(entropy[i])
        assert r.is_uncertain == (entropy[i] > 0.98)
        assert [m.sentiment for m in r.model_predictions] == [names[k] for k in p[i].argmax(axis=1)]


def test_ties_and_zero_entropy(spark):
    rows = [("t", 0, 0.4, 0.4, 0.2, 1.0), ("t", 1, 0.2, 0.4, 0.4, 1.0)]
    got = sc.model_argmax(spark.createDataFrame(rows, SCORES)).orderBy("model_ix").collect()
    assert [r.sentiment for r in got] == ["positive", "negative"]
    sure = spark.createDataFrame(
        [("s", 0, 1.0, 0.0, 0.0)], "article_hash string, pass int, p0 double, p1 double, p2 double"
    )
    assert sc.mc_uncertainty(sure).first().ensemble_uncertainty == 0


def test_params_checks():
    with pytest.raises(ValueError):
        Params(weights=(0.5, 0.3, 0.3))
    assert sc.params_for(toy.MODELS).weights == (0.5, 0.3, 0.2)
    with pytest.raises(ValueError):
        sc.register_model(toy.MODELS, "primary", 0.1, lambda: None)


def test_unknown_labels_add_up():
    assert sc.canonical_probs({"Positive": 0.5, "LABEL_7": 0.2, "other": 0.3}) == (0.5, 0, 0.5)


def test_score_texts(spark):
    df = spark.createDataFrame([("a", "shares rise"), ("b", "")], "article_hash string, headline string")
    rows = sc.score_texts(df, toy.MODELS).collect()
    assert len(rows) == 6
    first = next(r for r in rows if r.article_hash == "a" and r.model_ix == 0)
    assert first.positive_prob == pytest.approx(0.5) and first.latency_ms >= 0
    assert all(
        r.positive_prob + r.negative_prob + r.neutral_prob == pytest.approx(1) for r in rows
    )


def test_calibration_finds_the_brute_force_minimum(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet(np.ones(3) * 2, size=300)
    y = np.array([rng.choice(3, p=q**2 / (q**2).sum()) for q in p])
    rows = [(int(t), *map(float, q)) for t, q in zip(y, p)]
    df = spark.createDataFrame(
        rows, "y_true int, positive_prob double, negative_prob double, neutral_prob double"
    )
    z = np.log(p + 1e-9)

    def nll(t):
        s = z / t
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()

    grid = np.arange(0.1, 3, 0.001)
    best = grid[np.argmin([nll(t) for t in grid])]
    got = sc.calibrate_temperature(df).first()
    assert got.temperature == pytest.approx(best, abs=2e-3)
    assert got.nll <= nll(best) + 1e-9


def test_entities_and_fallback(spark):
    df = spark.createDataFrame(
        [("a", "AB and ABCD"), ("b", ""), ("c", "ABC boom"), ("d", "market crash")],
        "article_hash string, headline string",
    )

    def fails(text):
        if "boom" in text:
            raise RuntimeError
        return toy.entities(text)

    got = {r.article_hash: r.entities for r in mo.with_entities(df, fails).collect()}
    assert [(e.text, e.start_char, e.confidence) for e in got["a"]] == [("ABCD", 7, 1.0)]
    assert got["b"] == [] and got["c"] == []
    assert mo.with_entities(df).filter(F.size("entities") > 0).count() == 0

    def impact(text):
        assert "crash" not in text
        return "medium market impact" if "AB and" in text else "no idea"

    found = {r.article_hash: r.fallback_impact for r in mo.with_impact_fallback(df, impact).collect()}
    assert found == {"a": "medium", "b": "low", "c": "low", "d": None}


def test_analyse(spark):
    _, _, scores, drops = inputs(spark, n=2)
    texts = spark.createDataFrame([("a0", "x"), ("a1", "y")], "article_hash string, text string")
    rows = sc.analyse(texts, scores, drops).collect()
    assert {r.text for r in rows} == {"x", "y"} and rows[0].model_count == 3
