"""Classifier evaluation.

Input rows: y_true, y_pred (0..2), p0, p1, p2, preds (one class per model), uncertainty,
latency_ms. All metrics that depend on counts and sums come from one small grouped table
(`moments`, at most 3 x 3 x bins rows); rank metrics and percentiles use two-level running totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.probability import argmax3, bin_index, rounded
from tickerloom.functions.vocab import SENTIMENTS
from tickerloom.operators.ordering import quantiles, with_running_totals
from tickerloom.operators.sketches import exact_quantiles
from tickerloom.params import DEFAULTS, Params

_K = range(len(SENTIMENTS))
LATENCY_POINTS = {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}


def _plus(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise).cast("double"))


def _class_name(ix: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SENTIMENTS)), ix + 1)


def moments(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Counts and sums by (truth, prediction, confidence bin)."""
    p = [F.col(f"p{k}") for k in _K]
    confidence = F.greatest(*p)
    hit = (argmax3(*p) == F.col("y_true")).cast("double")
    brier = _plus(
        [F.pow((F.col("y_true") == k).cast("double") - p[k], F.lit(2.0)) for k in _K]
    ) / len(SENTIMENTS)
    disagree = F.coalesce(
        F.exists("preds", lambda x: x != F.get(F.col("preds"), F.lit(0))), F.lit(False)
    ).cast("int")
    prepared = rows.select(
        "y_true", "y_pred", bin_index(confidence, params.ece_bins).alias("bin"),
        confidence.alias("confidence"), hit.alias("hit"), brier.alias("brier"),
        disagree.alias("disagree"),
        (F.col("uncertainty") > params.uncertainty_threshold).cast("int").alias("uncertain"),
    )
    return prepared.groupBy("y_true", "y_pred", "bin").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in ("confidence", "hit", "brier", "disagree", "uncertain")],
    )


# --- confusion matrix ----------------------------------------------------------------------------


def _cell_sums() -> list[Column]:
    """c_<truth>_<prediction> for the 3 x 3 cells, zeros included."""
    return [
        F.expr(f"coalesce(sum(CASE WHEN y_true = {t} AND y_pred = {p} THEN n END), 0L)").alias(
            f"c_{t}_{p}"
        )
        for t in _K
        for p in _K
    ]


def _with_margins(cells: DataFrame) -> DataFrame:
    """Add row totals t_<k>, column totals p_<k> and the number of samples."""
    def total(names: list[str], alias: str) -> Column:
        return F.expr(" + ".join(names)).alias(alias)

    return cells.select(
        "*",
        *[total([f"c_{k}_{p}" for p in _K], f"t_{k}") for k in _K],
        *[total([f"c_{t}_{k}" for t in _K], f"p_{k}") for k in _K],
        total([f"c_{t}_{p}" for t in _K for p in _K], "n_samples"),
    )


def _cells(m: DataFrame) -> DataFrame:
    return _with_margins(m.agg(*_cell_sums()))


def _cell(t: int, p: int) -> Column:
    return F.col(f"c_{t}_{p}")


def _support(k: int) -> Column:
    return F.col(f"t_{k}")


def _predicted(k: int) -> Column:
    return F.col(f"p_{k}")


def _all_cells() -> Column:
    return F.col("n_samples")


def _f1(k: int) -> Column:
    return _ratio(2 * _cell(k, k), _support(k) + _predicted(k))


def confusion_matrix(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """All nine cells: count and share of the truth row."""
    cells = [
        F.struct(
            F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), _cell(t, p).alias("n"),
            rounded(_cell(t, p) / F.greatest(_support(t), F.lit(1)), 4).alias("row_share"),
        )
        for t in _K
        for p in _K
    ]
    return _cells(moments(rows, params)).select(F.inline(F.array(*cells)))


def _class_columns(k: int) -> dict[str, Column]:
    return {
        "precision": _ratio(_cell(k, k), _predicted(k)),
        "recall": _ratio(_cell(k, k), _support(k)),
        "f1": _f1(k),
        "support": _support(k),
        "share": _ratio(_support(k), _all_cells()),
    }


def class_metrics(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Precision, recall, F1, support and share of each class; 0 where undefined."""
    per_class = [
        F.struct(
            F.lit(k).alias("class_ix"), F.lit(SENTIMENTS[k]).alias("class_name"),
            *[c.alias(n) for n, c in _class_columns(k).items()],
        )
        for k in _K
    ]
    return _cells(moments(rows, params)).select(F.inline(F.array(*per_class)))


def _summary_columns() -> dict[str, Column]:
    n = _all_cells()
    right = _plus([_cell(k, k) for k in _K])
    occurring = _plus([((_support(k) + _predicted(k)) > 0).cast("int") for k in _K])
    # Products of counts pass 2^63 long before the counts do.
    support = [_support(k).cast("double") for k in _K]
    predicted = [_predicted(k).cast("double") for k in _K]
    total = n.cast("double")
    agree = _plus([a * b for a, b in zip(support, predicted)])
    spread = F.sqrt(
        (total * total - _plus([a * a for a in predicted]))
        * (total * total - _plus([a * a for a in support]))
    )
    expected = _ratio(agree, total * total, None)
    return {
        "n_samples": n,
        "accuracy": _ratio(right, n, None),
        "macro_f1": _ratio(_plus([_f1(k) for k in _K]), occurring),
        "micro_f1": _ratio(right, n, None),
        "weighted_f1": _ratio(_plus([_f1(k) * _support(k) for k in _K]), n),
        "mcc": _ratio(right * total - agree, spread),
        "cohen_kappa": _ratio(_ratio(right, n, None) - expected, 1 - expected, None),
    }


def f1_summary(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Accuracy, macro (over classes that occur), micro and weighted F1; MCC and kappa."""
    return _cells(moments(rows, params)).select(
        *[c.alias(n) for n, c in _summary_columns().items()]
    )


# --- calibration -----------------------------------------------------------------------------------


def ece_bins(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return moments(rows, params).groupBy("bin").agg(
        F.sum("n").alias("n"),
        (F.sum("hit") / F.sum("n")).alias("accuracy"),
        (F.sum("confidence") / F.sum("n")).alias("mean_confidence"),
    )


def ece(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    return _moments_row(moments(rows, params), params).select("ece")


def rates(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Brier score, disagreement rate and uncertain fraction."""
    return _moments_row(moments(rows, params), params).select(
        "brier_score", "ensemble_disagreement", "uncertain_fraction"
    )


def reliability(rows: DataFrame, class_ix: int = 0, bins: int = 10) -> DataFrame:
    """Mean predicted probability and observed fraction by right-closed bin; non-empty bins."""
    p = F.col(f"p{class_ix}")
    return rows.groupBy(bin_index(p, bins, closed="right").alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(p).alias("mean_predicted_prob"),
        F.avg((F.col("y_true") == class_ix).cast("double")).alias("fraction_positive"),
    )


# --- ranking -----------------------------------------------------------------------------------------


def rank_metrics(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """ROC-AUC (ties half) and average precision per class, one-vs-rest; null where undefined.

    Rows are first reduced to distinct (class, score), so ties cost nothing, and running totals
    are taken over those.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(k).alias("class_ix"), F.col(f"p{k}").alias("score"),
                (F.col("y_true") == k).cast("long").alias("hit"),
            )
            for k in _K
        ]
    )
    scores = (
        rows.select(F.inline(entries))
        .groupBy("class_ix", "score")
        .agg(F.sum("hit").alias("pos"), (F.count("*") - F.sum("hit")).alias("neg"))
    )
    swept = with_running_totals(
        scores, "score", ["pos", "neg"], by=["class_ix"], descending=True,
        buckets=params.order_buckets,
    )
    reached = F.col("pos_before") + F.col("pos")
    seen = reached + F.col("neg_before") + F.col("neg")
    area = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    precision = F.sum(F.col("pos") * (reached / seen))
    found = swept.groupBy("class_ix").agg(
        area.alias("area"), precision.alias("precision_sum"),
        F.max("pos_total").alias("positives"), F.max("neg_total").alias("negatives"),
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return found.select(
        "class_ix",
        _class_name(F.col("class_ix")).alias("class_name"),
        _ratio(F.col("area"), pairs, None).alias("roc_auc"),
        F.when(F.col("negatives") > 0, _ratio(F.col("precision_sum"), F.col("positives"), None))
        .otherwise(_ratio(F.col("positives"), F.col("positives"), None)).alias("pr_auc"),
    )


def latency_percentiles(
    rows: DataFrame, params: Params = DEFAULTS, sketches: DataFrame | None = None
) -> DataFrame:
    """With stored sketches of these rows, few of the distinct latencies are ordered."""
    buckets = params.order_buckets
    if sketches is None:
        found = quantiles(rows, "latency_ms", LATENCY_POINTS, buckets=buckets)
    else:
        found = exact_quantiles(rows, sketches, "latency_ms", LATENCY_POINTS, buckets=buckets)
    return found.select(*[rounded(F.col(c), 2).alias(c) for c in LATENCY_POINTS])


# --- report ------------------------------------------------------------------------------------------


def _long(df: DataFrame, names: dict[str, Column]) -> DataFrame:
    pairs = [
        F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value"))
        for k, v in names.items()
    ]
    return df.select(F.inline(F.array(*pairs)))


def _moments_row(m: DataFrame, params: Params) -> DataFrame:
    """The whole of `moments` as one row: cells, sums, and the calibration gap of each bin."""
    n = F.sum("n")
    gaps = [
        f"abs(coalesce(sum(CASE WHEN bin = {b} THEN hit - confidence END), 0.0D))"
        for b in range(params.ece_bins)
    ]
    row = m.agg(
        *_cell_sums(),
        _ratio(F.expr(" + ".join(gaps)), n, None).alias("ece"),
        *[
            _ratio(F.sum(source), n, None).alias(name)
            for name, source in (
                ("brier_score", "brier"), ("ensemble_disagreement", "disagree"),
                ("uncertain_fraction", "uncertain"),
            )
        ],
    )
    return _with_margins(row)


def flatten_report(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The report as (metric, value): 15 overall names and 6 per class.

    Three passes over the input: one for all counts and sums, one for ranks, one for latency;
    each ends in a single row that is turned into named values.
    """
    row = _moments_row(moments(rows, params), params)
    summary = _summary_columns()
    overall = ("macro_f1", "micro_f1", "weighted_f1", "mcc", "cohen_kappa", "accuracy")
    named = {f"eval/{c}": rounded(summary[c], 6) for c in overall}
    named["eval/n_samples"] = summary["n_samples"]
    for c, places in (
        ("ece", 6), ("brier_score", 6), ("ensemble_disagreement", 4), ("uncertain_fraction", 4)
    ):
        named[f"eval/{c}"] = rounded(F.col(c), places)
    for k, name in enumerate(SENTIMENTS):
        for c, value in _class_columns(k).items():
            if c != "share":
                named[f"eval/{name}/{c}"] = value

    curves = ("pr_auc", "roc_auc")
    ranks = rank_metrics(rows, params).agg(
        F.avg("roc_auc").alias("macro"),
        *[
            F.max(F.when(F.col("class_ix") == k, F.col(c))).alias(f"{c}_{k}")
            for k in _K for c in curves
        ],
    )
    ranked = {"eval/macro_roc_auc": rounded(F.col("macro"), 6)} | {
        f"eval/{SENTIMENTS[k]}/{c}": F.col(f"{c}_{k}") for k in _K for c in curves
    }
    latency = latency_percentiles(rows, params)
    return (
        _long(row, named)
        .unionByName(_long(ranks, ranked))
        .unionByName(_long(latency, {f"eval/{c}": F.col(c) for c in LATENCY_POINTS}))
    )


_WIDE = (
    "macro_f1", "micro_f1", "weighted_f1", "macro_roc_auc", "mcc", "cohen_kappa", "accuracy",
    "ece", "brier_score", "ensemble_disagreement", "uncertain_fraction", "p50_ms", "p95_ms",
    "p99_ms", "n_samples",
)
_PER_CLASS = ("precision", "recall", "f1", "pr_auc", "roc_auc", "support")


def evaluate(rows: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """The report as one wide row. An empty input is an error when the row is computed."""
    def value(name: str) -> Column:
        return F.max(F.when(F.col("metric") == f"eval/{name}", F.col("value")))

    wide = flatten_report(rows, params).agg(
        *[value(c).alias(c) for c in _WIDE],
        *[value(f"{s}/{c}").alias(f"{s}_{c}") for s in SENTIMENTS for c in _PER_CLASS],
    )
    counted = F.when(
        F.col("n_samples") > 0, F.col("n_samples").cast("long")
    ).otherwise(F.raise_error(F.lit("empty evaluation set")).cast("long"))
    return wide.withColumn("n_samples", counted)


def noisy_truth(
    rows: DataFrame, key: str, percent: int = 15, seed: int = 42
) -> DataFrame:
    """Replace about `percent` of the labels by a repeatable pseudo-random class (fixtures)."""
    def draw(tag: str, modulus: int) -> Column:
        text = F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)), F.lit(tag))
        return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(modulus))

    return rows.withColumn(
        "y_true",
        F.when(draw("flip", 100) < percent, draw("class", 3).cast("int")).otherwise(
            F.col("y_true")
        ),
    )


def labels_or_prediction(
    results: DataFrame, labels: DataFrame, key: str = "headline"
) -> DataFrame:
    """`y_true`: the known label of the row's key, else what was predicted."""
    known = labels.select(key, F.col("label").alias("__label"))
    predicted = F.col("y_pred")
    from_label = F.array_position(F.array(*map(F.lit, SENTIMENTS)), F.col("__label")) - 1
    found = F.when(F.col("__label").isNull(), predicted).otherwise(
        F.when(from_label >= 0, from_label.cast("int")).otherwise(F.lit(2))
    )
    return results.join(known, key, "left").withColumn("y_true", found).drop("__label")
