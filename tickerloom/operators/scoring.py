"""Ensemble scoring over score tables, and the hook that fills those tables from user models.

Score table: one row per (article, model). Pass table: one row per (article, stochastic pass).
Both are reduced to one row per article by plain hash aggregates, so partial aggregation runs
before the shuffle and both sides of the join below already share its partitioning.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.probability import argmax3, entropy3, sentiment_name, tempered
from tickerloom.functions.vocab import SENTIMENTS
from tickerloom.params import DEFAULTS, Params
from tickerloom.schemas import MODEL_SCORES

_PROBS = ("positive_prob", "negative_prob", "neutral_prob")


# --- user models -----------------------------------------------------------------------------

# Texts in, one label-to-probability mapping per text out.
ModelFn = Callable[[Sequence[str]], Sequence[Mapping[str, float]]]


@dataclass(frozen=True)
class Model:
    """A named classifier. `load` runs once per Python worker and returns the callable."""

    name: str
    weight: float
    load: Callable[[], ModelFn]


_loaded: dict[str, ModelFn] = {}


def register_model(
    registry: tuple[Model, ...], name: str, weight: float, load: Callable[[], ModelFn]
) -> tuple[Model, ...]:
    """A registry with one more model; the order gives the model index."""
    if any(m.name == name for m in registry):
        raise ValueError(f"model {name!r} is registered already")
    return (*registry, Model(name, weight, load))


def params_for(registry: Sequence[Model], **changes: object) -> Params:
    return Params(
        model_names=tuple(m.name for m in registry),
        weights=tuple(m.weight for m in registry),
        **changes,  # type: ignore[arg-type]
    )


def canonical_probs(scores: Mapping[str, float]) -> tuple[float, float, float]:
    """Labels in any case to class order; labels outside the three add up under neutral."""
    total = dict.fromkeys(SENTIMENTS, 0.0)
    for label, p in scores.items():
        name = label.lower()
        total[name if name in total else "neutral"] += float(p)
    return total["positive"], total["negative"], total["neutral"]


def leading_words(text: Column, most: int) -> Column:
    """The text up to its `most`-th word, white space kept; unchanged if it has no more words."""
    if most < 1:
        raise ValueError(f"at least one word must stay, got {most}")
    return F.regexp_extract(text, rf"^\s*+(?:\S++\s++){{0,{most - 1}}}+\S*+(?:\s++\z)?", 0)


def score_texts(
    articles: DataFrame,
    models: Sequence[Model],
    text: str = "headline",
    batch_size: int | None = None,
    max_tokens: int | None = None,
) -> DataFrame:
    """Run the models over `text` in Arrow batches; returns the score table.

    A model receives at most `batch_size` texts at a time (None: a whole Arrow batch), which bounds
    the memory of its padded input. `max_tokens` cuts texts to that many words before they leave the JVM. A
    model's own tokenizer makes one token or more of each word, so a model that reads that many
    tokens loses nothing. A null text stays null.
    """
    models = tuple(models)
    if batch_size is not None and batch_size < 1:
        raise ValueError(f"a batch holds at least one text, got {batch_size}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            size = batch_size or max(1, len(whole))
            for at in range(0, len(whole), size):
                batch = whole.iloc[at : at + size]
                texts = batch["text"].tolist()
                for index, model in enumerate(models):
                    if model.name not in _loaded:
                        _loaded[model.name] = model.load()
                    start = time.perf_counter()
                    probs = [canonical_probs(s) for s in _loaded[model.name](texts)]
                    took_ms = (time.perf_counter() - start) * 1000 / len(texts)
                    out = pd.DataFrame(probs, columns=list(_PROBS))
                    out.insert(0, "article_hash", batch["article_hash"].to_numpy())
                    out.insert(1, "model_ix", index)
                    out["latency_ms"] = took_ms
                    yield out

    given = F.col(text) if max_tokens is None else leading_words(F.col(text), max_tokens)
    return articles.select("article_hash", given.alias("text")).mapInPandas(run, MODEL_SCORES)


# --- combination -----------------------------------------------------------------------------


def one_row_per_article(scores: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """`model_predictions` in model order. A redelivered score row changes nothing."""
    columns = (*_PROBS, "latency_ms")
    picked = scores.groupBy("article_hash").agg(
        *[
            F.max(F.when(F.col("model_ix") == i, F.col(c))).alias(f"{c}_{i}")
            for i in range(len(params.weights))
            for c in columns
        ]
    )

    def prediction(i: int) -> Column:
        p = [F.col(f"{c}_{i}") for c in _PROBS]
        return F.struct(
            F.lit(params.model_names[i]).alias("model_name"),
            sentiment_name(argmax3(*p)).alias("sentiment"),
            *[c.alias(n) for n, c in zip(_PROBS, p)],
            F.col(f"latency_ms_{i}").alias("latency_ms"),
        )

    weighted = [
        reduce(
            lambda a, b: a + b,
            [F.col(f"{c}_{i}") * F.lit(w) for i, w in enumerate(params.weights)],
        ).alias(c)
        for c in _PROBS
    ]
    every = F.array(*[prediction(i) for i in range(len(params.weights))])
    return picked.select("article_hash", *weighted, every.alias("model_predictions"))


def model_argmax(scores: DataFrame) -> DataFrame:
    """Each model's own winner."""
    p = [F.col(c) for c in _PROBS]
    return scores.select("article_hash", "model_ix", sentiment_name(argmax3(*p)).alias("sentiment"))


def ensemble_average(scores: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return one_row_per_article(scores, params).select("article_hash", *_PROBS)


def temperature_scale(averaged: DataFrame, temperature: Column | float = 1.0) -> DataFrame:
    """Softmax of ln(p + 1e-9) / T over the three probabilities."""
    others = [c for c in averaged.columns if c not in _PROBS]
    raised = averaged.select(*others, *[tempered(F.col(c), temperature).alias(c) for c in _PROBS])
    total = F.col(_PROBS[0]) + F.col(_PROBS[1]) + F.col(_PROBS[2])
    return raised.select(*others, *[(F.col(c) / total).alias(c) for c in _PROBS])


def decide(scaled: DataFrame) -> DataFrame:
    p = [F.col(c) for c in _PROBS]
    return scaled.select(
        "*",
        sentiment_name(argmax3(*p)).alias("ensemble_sentiment"),
        F.greatest(*p).alias("ensemble_confidence"),
    )


def mc_uncertainty(passes: DataFrame) -> DataFrame:
    """Entropy, over ln 3, of the mean of the stochastic passes."""
    means = passes.groupBy("article_hash").agg(*[F.avg(f"p{i}").alias(f"p{i}") for i in range(3)])
    return means.select(
        "article_hash",
        entropy3(F.col("p0"), F.col("p1"), F.col("p2")).alias("ensemble_uncertainty"),
    )


def predict(scores: DataFrame, passes: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Average, temperature, decision, uncertainty and per-model predictions of each article."""
    decided = decide(temperature_scale(one_row_per_article(scores, params), params.temperature))
    joined = decided.join(mc_uncertainty(passes), "article_hash")
    return joined.withColumn(
        "is_uncertain", F.col("ensemble_uncertainty") > F.lit(params.uncertainty_threshold)
    )


def analyse(
    texts: DataFrame, scores: DataFrame, passes: DataFrame, params: Params = DEFAULTS
) -> DataFrame:
    """On-demand scoring of (article_hash, text) rows."""
    return texts.join(predict(scores, passes, params), "article_hash").select(
        "text",
        F.col("ensemble_sentiment").alias("sentiment"),
        F.col("ensemble_confidence").alias("confidence"),
        F.col("ensemble_uncertainty").alias("uncertainty"),
        "is_uncertain",
        *_PROBS,
        F.lit(len(params.weights)).alias("model_count"),
        F.lit(float(params.temperature)).alias("temperature"),
    )


# --- calibration -----------------------------------------------------------------------------

_REFINE = 8
_PASSES = 5


def calibrate_temperature(labelled: DataFrame, low: float = 0.05, high: float = 20.0) -> DataFrame:
    """One row (temperature, nll): the T with the least mean cross-entropy.

    `labelled` holds y_true and three probabilities; ln(p + 1e-9) are the logits. The loss has a
    single minimum in ln T, so each pass tries 2 x 8 + 1 points in one scan, and the next pass
    looks at the two cells around the best. One pair of numbers per pass comes to the driver.
    """
    z = [F.col(f"z{i}") for i in range(3)]
    rows = labelled.select(
        "y_true", *[F.log(F.col(c) + 1e-9).alias(f"z{i}") for i, c in enumerate(_PROBS)]
    )
    own = F.when(F.col("y_true") == 0, z[0]).when(F.col("y_true") == 1, z[1]).otherwise(z[2])
    top = F.greatest(*z)

    def best_of(tried: list[float]) -> DataFrame:
        points = []
        for log_t in tried:
            t = math.exp(log_t)
            spread = F.exp((z[0] - top) / t) + F.exp((z[1] - top) / t) + F.exp((z[2] - top) / t)
            loss = F.avg(F.log(spread) + (top - own) / t)
            points.append(F.struct(loss.alias("nll"), F.lit(log_t).alias("log_t")))
        return rows.agg(F.array_min(F.array(*points)).alias("best")).select("best.*")

    centre, half = (math.log(high) + math.log(low)) / 2, (math.log(high) - math.log(low)) / 2
    for left in reversed(range(_PASSES)):
        found = best_of([centre + half * k / _REFINE for k in range(-_REFINE, _REFINE + 1)])
        if left:
            centre, half = found.first()["log_t"], half / _REFINE
    return found.select(F.exp("log_t").alias("temperature"), "nll")
