"""Histogram gradient-boosted trees over document statistics; trees are flat arrays for scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.labels import held_out
from tickerloom.llm.quality import SYMBOLS, repeated_lines, repeated_words
from tickerloom.llm.words import WHITE, Texts, byte_class, text_slices, totals, words_of
from tickerloom.session import prepare

_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "symbol": SYMBOLS,
    "stop": b".",
    "comma": b",;:",
    "loud": b"!?",
    "bar": b"|",
    "quote": b"\"'`()[]{}",
    "slash": b"/\\@_=+~^-",
    "high": bytes(range(0x80, 0x100)),
    "white": WHITE,
}
STATISTICS = (
    "bytes", "words", "lines", "word_length", "line_words", "distinct_words", "repeat_words",
    "dup_lines", "ratio", *(f"{name}_share" for name in _CLASSES),
)


def statistics(texts: Texts) -> np.ndarray:
    """One row of STATISTICS per text; 0 where a quotient has nothing to divide."""
    words = words_of(texts)
    size, n = np.diff(texts.offsets).astype(float), words.counts.astype(float)
    newlines = texts.per_text(byte_class(b"\n")) + 1.0
    owner = words.owner()
    order = np.lexsort((words.hashes, owner))
    h, o = words.hashes[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = totals(fresh, words.first)
    packer = zstandard.ZstdCompressor(level=1)
    packed, dup = np.ones(len(texts)), np.zeros(len(texts))
    for i in range(len(texts)):
        text = texts.text(i)
        packed[i] = len(packer.compress(text))
        dup[i] = repeated_lines(text)
    counts = {name: texts.per_text(byte_class(members)) for name, members in _CLASSES.items()}
    word, byte = np.maximum(n, 1), np.maximum(size, 1)
    columns = [
        np.log1p(size), np.log1p(n), np.log1p(newlines), (size - counts["white"]) / word,
        n / newlines, distinct / word, repeated_words(words) / word, dup / newlines, size / packed,
        *(v / byte for v in counts.values()),
    ]
    return np.column_stack(columns).astype(np.float64)


def with_statistics(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, x array<double>) of whole texts; null texts count as empty."""
    key = docs.schema[id_col].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                x = statistics(texts)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), lists.cast(pa.list_(pa.float64()))], [id_col, "x"]
                )

    return docs.select(id_col, "text").mapInArrow(describe, f"`{id_col}` {key}, x array<double>")


@dataclass(frozen=True)
class Forest:
    """All trees node by node. A leaf is its own child, so a fixed number of steps reaches one."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: every row goes down every tree in step."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[row, self.feature[at]] <= self.cut[at]
            at = np.where(low, self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit_forest(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 60,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    l2: float = 1.0,
    least: int = 8,
) -> Forest:
    """Newton boosting on logistic loss; splits are sought on per-bin sums of gradients.

    Without rows, or with one class only, the forest is a constant.
    """
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    n_features = x.shape[1] if x.ndim == 2 else 0
    both = len(y) and 0 < y.sum() < len(y)
    if both:
        grid = np.linspace(0, 1, bins + 1)[1:-1]
        edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(n_features)]
        binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
        margin = np.full(len(y), base)
    for _ in range(trees if both else 0):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, 0.0, 0, 0, 0.0])
        level = [(roots[-1], np.arange(len(y)))]
        for step in range(depth + 1):
            below = []
            for node, rows in level:
                g, h = grad[rows], hess[rows]
                here = _best_split(binned[rows], g, h, edges, l2, least) if step < depth else None
                if here is None:
                    weight = -rate * g.sum() / (h.sum() + l2)
                    nodes[node] = [0, np.inf, node, node, weight]
                    margin[rows] += weight
                    continue
                f, b = here
                left, right = len(nodes), len(nodes) + 1
                nodes[node] = [f, edges[f][b], left, right, 0.0]
                nodes += [[0, 0.0, 0, 0, 0.0], [0, 0.0, 0, 0, 0.0]]
                low = binned[rows, f] <= b
                below += [(left, rows[low]), (right, rows[~low])]
            level = below
    table = np.array(nodes or [[0, np.inf, 0, 0, 0.0]], dtype=float)
    whole = table[:, [0, 2, 3]].astype(np.int32)
    return Forest(
        whole[:, 0], table[:, 1], whole[:, 1], whole[:, 2], table[:, 4],
        np.array(roots or [0], dtype=np.int32), depth, base,
    )


def _best_split(binned, g, h, edges, l2, least):
    """(feature, last bin on the left) of the largest gain, or None."""
    best, where = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + l2)
    for f, cuts in enumerate(edges):
        size = len(cuts) + 1
        if size < 2:
            continue
        gs = np.cumsum(np.bincount(binned[:, f], g, size))[:-1]
        hs = np.cumsum(np.bincount(binned[:, f], h, size))[:-1]
        ns = np.cumsum(np.bincount(binned[:, f], minlength=size))[:-1]
        gain = gs**2 / (hs + l2) + (g.sum() - gs) ** 2 / (h.sum() - hs + l2) - whole
        gain[(ns < least) | (len(g) - ns < least)] = 0
        if gain.max() > best:
            best, where = gain.max(), (f, int(gain.argmax()))
    return where


def _hash_limit(share: float) -> int:
    """The signed 64-bit number below which about `share` of evenly spread hashes lie."""
    return int(min(share, 1.0) * (2**64 - 1)) - 2**63


def train(
    x: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000
) -> Forest:
    """Fit on at most `max_rows` labelled rows that are not held out.

    The rows are those with the smallest hash of id and statistics, so a run is repeatable; rows equal in
    both count once. Labels other than 0 and 1 are left out; of several labels for one id the largest
    counts. Hashes are evenly spread, so those above a limit set from the number of rows are left out
    before the sort: the driver receives little more than `max_rows` rows from any number of tasks.
    """
    own = (
        labels.filter(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label_col).alias("y"))
    )
    labelled = (
        x.join(own, x[id_col] == own["__id"])
        .select("x", "y", F.xxhash64("__id", "x").alias("o"))
        .distinct()
        .checkpoint()
    )
    total, share = labelled.count(), 1.0
    near = labelled
    if total > max_rows:
        share = 1.2 * max_rows / total
        near = labelled.filter(F.col("o") < _hash_limit(share))
        while near.count() < max_rows:
            share *= 2
            near = labelled.filter(F.col("o") < _hash_limit(share)) if share < 1 else labelled
    chosen = near.orderBy("o", "x", "y").limit(max_rows).toPandas()
    rows = np.array(chosen["x"].tolist(), dtype=float).reshape(len(chosen), len(STATISTICS))
    return fit_forest(rows, chosen["y"].to_numpy(dtype=float))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 20_000
) -> DataFrame:
    """(id, held_out, score, predicted) for every row; without usable labels every score is 0.5.

    Only the text is described: no label, language, source or id enters a score. An empty text has
    the statistics of no words. Repeated rows are scored each.
    """
    prepare(docs.sparkSession)
    x = with_statistics(docs, id_col).checkpoint()
    forest = train(x, labels, id_col, label_col, max_rows)
    key = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column(1).flatten()).reshape(batch.num_rows, len(STATISTICS))
            parts = [forest.score(rows[a : a + 4096]) for a in range(0, len(rows), 4096)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.concatenate([np.zeros(0), *parts]))], [id_col, "score"]
            )

    scored = x.mapInArrow(score, f"`{id_col}` {key}, score double")
    return scored.select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
