"""Every setting that changes a result, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # ensemble
    model_names: tuple[str, ...] = ("primary", "secondary", "tertiary")
    weights: tuple[float, ...] = (0.5, 0.3, 0.2)
    dropout_passes: int = 10
    temperature: float = 1.0
    uncertainty_threshold: float = 0.15
    entity_min_score: float = 0.80
    # ingestion
    # None takes every item of a feed, and every unique article.
    feed_item_cap: int | None = None
    fetch_cap: int | None = None
    dedup_window_seconds: int = 86_400
    near_distance: int = 3
    # serving
    latest_cap: int = 1_000
    cache_ttl_seconds: int = 3_600
    ticker_ttl_seconds: int = 300
    ticker_row_cap: int = 200
    rate_limit: int = 60
    rate_window_seconds: int = 60
    # evaluation and drift
    ece_bins: int = 15
    psi_bins: int = 10
    psi_threshold: float = 0.2
    chi2_alpha: float = 0.01
    js_threshold: float = 0.1
    # how finely an ordered table is cut before running totals are taken
    order_buckets: int = 1_024

    def __post_init__(self) -> None:
        if abs(sum(self.weights) - 1.0) > 1e-6:
            raise ValueError(f"ensemble weights must sum to 1, got {sum(self.weights)}")
        if len(self.weights) != len(self.model_names):
            raise ValueError("one weight per model name")


DEFAULTS = Params()
