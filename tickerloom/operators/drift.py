"""Drift between a reference and a current set of results."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.probability import bin_index, rounded
from tickerloom.functions.vocab import SENTIMENTS
from tickerloom.operators.ordering import value_at_rank
from tickerloom.operators.results import recent, since
from tickerloom.params import DEFAULTS, Params

_SIDES = ("ref", "cur")
_K = range(len(SENTIMENTS))
_PROBS = ("positive_prob", "negative_prob", "neutral_prob")
_TINY = 1e-9


def _plus(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _profile(rows: DataFrame, params: Params) -> DataFrame:
    """Reduce rows marked with `side` to one row of counts and sums for both sides."""
    x = F.col("ensemble_confidence")
    inside = (x >= 0) & (x <= 1)
    bin_no = F.when(inside, bin_index(x, params.psi_bins))
    aggregates = []
    for side in _SIDES:
        here = F.col("side") == side
        aggregates.append(F.count_if(here).alias(f"{side}_n"))
        aggregates += [
            F.count_if(here & (bin_no == b)).alias(f"{side}_bin_{b}")
            for b in range(params.psi_bins)
        ]
        aggregates += [
            F.count_if(here & (F.col("ensemble_sentiment") == s)).alias(f"{side}_label_{k}")
            for k, s in enumerate(SENTIMENTS)
        ]
        aggregates += [
            F.avg(F.when(here, F.col(p))).alias(f"{side}_prob_{k}") for k, p in enumerate(_PROBS)
        ]
    return rows.agg(*aggregates)


def _both(reference: DataFrame, current: DataFrame) -> DataFrame:
    columns = ("ensemble_confidence", "ensemble_sentiment", *_PROBS)
    return reference.select(F.lit("ref").alias("side"), *columns).unionByName(
        current.select(F.lit("cur").alias("side"), *columns)
    )


def _over(part: Column, whole: Column) -> Column:
    """A share; null where there is nothing to share."""
    return part / F.nullif(whole, F.lit(0))


def _psi(params: Params) -> Column:
    terms = []
    for b in range(params.psi_bins):
        r, c = (
            F.greatest(_over(F.col(f"{s}_bin_{b}"), F.col(f"{s}_n")), F.lit(1e-6)) for s in _SIDES
        )
        terms.append((c - r) * F.log(c / r))
    return _plus(terms)


def _label_shares(side: str) -> list[Column]:
    total = _plus([F.col(f"{side}_label_{k}") for k in _K])
    return [_over(F.col(f"{side}_label_{k}"), total) for k in _K]


def _chi2_pvalue() -> Column:
    """Two rows by three columns: two degrees of freedom, for which p = exp(-chi2 / 2)."""
    current_total = _plus([F.col(f"cur_label_{k}") for k in _K])
    observed = [F.greatest(F.col(f"cur_label_{k}").cast("double"), F.lit(1.0)) for k in _K]
    scaled = [F.greatest(s * current_total, F.lit(1.0)) for s in _label_shares("ref")]
    total_o, total_s = _plus(observed), _plus(scaled)
    total = total_o + total_s
    terms = []
    for k in _K:
        column = observed[k] + scaled[k]
        for cell, row_total in ((observed[k], total_o), (scaled[k], total_s)):
            expected = row_total * column / total
            terms.append(F.pow(cell - expected, F.lit(2.0)) / expected)
    return F.exp(-_plus(terms) / 2)


def _js() -> Column:
    """Reference label shares against current mean probabilities, natural logarithm."""
    def smoothed(values: list[Column]) -> list[Column]:
        raised = [v + _TINY for v in values]
        total = _plus(raised)
        return [v / total for v in raised]

    def divergence(p: list[Column], m: list[Column]) -> Column:
        terms = [F.when(a > 0, a * F.log(a / b)).otherwise(0.0) for a, b in zip(p, m)]
        return _plus(terms)

    p = smoothed(_label_shares("ref"))
    q = smoothed([F.col(f"cur_prob_{k}") for k in _K])
    middle = [(a + b) / 2 for a, b in zip(p, q)]
    return F.least((divergence(p, middle) + divergence(q, middle)) / 2, F.lit(1.0))


def psi_band(value: Column) -> Column:
    return F.when(value < 0.1, "stable").when(value <= 0.2, "moderate").otherwise("significant")


def _measures(profile: DataFrame, params: Params, *kept: str) -> DataFrame:
    return profile.select(
        *kept, "ref_n", "cur_n", _psi(params).alias("psi"), _js().alias("js"), _chi2_pvalue().alias("p")
    )


def psi(reference: DataFrame, current: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    measured = _measures(_profile(_both(reference, current), params), params)
    return measured.select(
        rounded(F.col("psi"), 6).alias("psi"), psi_band(F.col("psi")).alias("band")
    )


def chi2_label_drift(reference: DataFrame, current: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    measured = _measures(_profile(_both(reference, current), params), params)
    return measured.select(rounded(F.col("p"), 6).alias("chi2_pvalue"))


def js_divergence(reference: DataFrame, current: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    measured = _measures(_profile(_both(reference, current), params), params)
    return measured.select(rounded(F.col("js"), 6).alias("js_divergence"))


def report_of(profile: DataFrame, params: Params, checked_at: Column | None = None) -> DataFrame:
    """A report for each row of counts and means of both sides."""
    alerts = F.array(
        F.when(
            F.col("psi") > params.psi_threshold,
            F.format_string(f"PSI=%.4f > {params.psi_threshold}", "psi"),
        ),
        F.when(F.col("p") < params.chi2_alpha, F.format_string("Label drift chi2 p=%.4f", "p")),
        F.when(F.col("js") > params.js_threshold, F.format_string("Prediction drift JS=%.4f", "js")),
    )
    timed = profile.withColumn("timestamp", F.current_timestamp() if checked_at is None else checked_at)
    measured = _measures(timed, params, "timestamp").withColumn("alerts", F.array_compact(alerts))
    return measured.select(
        "timestamp",
        F.col("ref_n").alias("reference_rows"),
        F.col("cur_n").alias("current_rows"),
        rounded(F.col("psi"), 6).alias("psi_confidence"),
        rounded(F.col("js"), 6).alias("js_divergence"),
        rounded(F.col("p"), 6).alias("chi2_pvalue"),
        (F.size("alerts") > 0).alias("is_drifting"),
        "alerts",
        psi_band(F.col("psi")).alias("psi_band"),
    )


def drift_report(
    reference: DataFrame, current: DataFrame, params: Params = DEFAULTS,
    checked_at: Column | None = None,
) -> DataFrame:
    """One row; both sides are reduced in one aggregate."""
    return report_of(_profile(_both(reference, current), params), params, checked_at)


def _window(results: DataFrame, as_of: datetime | Column, hours: int, most: int | None) -> DataFrame:
    return since(results, as_of, hours) if most is None else recent(results, as_of, hours, most)


def drift_check(
    results: DataFrame,
    as_of: datetime | Column,
    lookback_hours: int = 1,
    reference_hours: int = 24,
    params: Params = DEFAULTS,
    exclude_current: bool = False,
    min_reference: int = 50,
    min_current: int = 10,
    newest_current: int | None = None,
    newest_reference: int | None = None,
) -> DataFrame:
    """The last hour against the last day; no row if either is thin.

    All rows of both windows are compared, in one aggregate. `newest_current` and `newest_reference`
    ask for so many of the newest rows instead.
    """
    current = _window(results, as_of, lookback_hours, newest_current)
    base = results
    if exclude_current:
        base = base.filter(
            F.col("published_at") < F.lit(as_of) - F.make_interval(hours=F.lit(lookback_hours))
        )
    reference = _window(base, as_of, reference_hours, newest_reference)
    checked_at = as_of if isinstance(as_of, Column) else F.lit(as_of)
    report = drift_report(reference, current, params, checked_at)
    return report.filter(
        (F.col("reference_rows") >= min_reference) & (F.col("current_rows") >= min_current)
    )


def drift_metrics(report: DataFrame) -> DataFrame:
    """Report to (metric, value, tag); the tag carries the alert text."""
    tag = F.when(F.col("is_drifting"), F.concat_ws("; ", "alerts"))
    rows = [
        F.struct(F.lit(name).alias("metric"), F.col(c).alias("value"), tag.alias("drift_alert"))
        for name, c in (
            ("drift/psi", "psi_confidence"),
            ("drift/js", "js_divergence"),
            ("drift/chi2_pvalue", "chi2_pvalue"),
        )
    ]
    return report.select(F.inline(F.array(*rows)))


# --- halves --------------------------------------------------------------------------------------


def mark_halves(
    results: DataFrame, ts: str = "published_at", key: str = "article_hash",
    params: Params = DEFAULTS,
) -> DataFrame:
    """Add `side`: the newest floor(n / 2) rows are 'cur', the others 'ref'. Ties go by hash.

    The cut is an exact (time, hash) pair found by order statistics: first the time that holds the
    middle rank, then the hash among the rows of that one moment. Each step brings one row of
    two numbers to the driver. Every row is then placed by comparing it with the pair; no row is
    numbered.
    """
    own_at = F.unix_micros(ts)
    own_head = F.conv(F.substring(key, 1, 15), 16, 10).cast("long")
    own_digit = F.conv(F.substring(key, 16, 1), 16, 10).cast("long")
    at = results.select(own_at.alias("at"), own_head.alias("head"), own_digit.alias("digit"))

    def holder(rows: DataFrame, value: str, rank: int, newest_first: bool = False) -> tuple[int, int]:
        """The value at a rank, and the rank left over among the rows of that value."""
        row = value_at_rank(
            rows, value, F.lit(rank), descending=newest_first, buckets=params.order_buckets
        ).first()
        return (row["value"], rank - row["before"]) if row else (0, 0)

    half = results.count() // 2
    cut_at, left = holder(at, "at", half, newest_first=True)
    if left == 0:
        return results.withColumn("side", F.when(own_at > cut_at, "cur").otherwise("ref"))
    tied = at.filter(F.col("at") == cut_at)
    cut_head, left = holder(tied, "head", left)
    cut_digit, _ = holder(tied.filter(F.col("head") == cut_head), "digit", left)
    newer = (own_at > cut_at) | (
        (own_at == cut_at)
        & ((own_head < cut_head) | ((own_head == cut_head) & (own_digit < cut_digit)))
    )
    return results.withColumn("side", F.when(newer, "cur").otherwise("ref"))


def drift_split_half(
    results: DataFrame, params: Params = DEFAULTS, checked_at: Column | None = None,
    min_rows: int = 20,
) -> DataFrame:
    """Newer half against older half; no row under `min_rows`."""
    marked = mark_halves(results, params=params)
    report = report_of(_profile(marked, params), params, checked_at)
    return report.filter(F.col("reference_rows") + F.col("current_rows") >= min_rows)
