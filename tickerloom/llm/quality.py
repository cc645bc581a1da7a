"""Compression bands: texts that pack too well repeat themselves, texts that hardly pack are noise."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.labels import held_out
from tickerloom.llm.words import Texts, Words, byte_class, mix, text_slices, totals, words_of

SYMBOLS = b"#*$%&|<>"
#: UTF-8 continuation bytes and white space: bytes that do not begin a character of a word.
_NOT_INK = byte_class(bytes(range(0x80, 0xC0)) + b" \t\n\x0b\x0c\r")


@dataclass(frozen=True)
class Bands:
    """Limits of bytes / compressed bytes by length of the text in bytes.

    `whole` and `chunks` list (least length, lowest, highest ratio) in ascending order of length. `whole`
    judges the text as one; shorter texts than its first entry are not judged by compression. `chunks`
    judges every piece of `chunk` bytes of texts with at least one whole piece; the last piece is the final
    `chunk` bytes, so every byte is in a piece of that size. A text fails if more than `chunk_share` of its
    pieces are outside. Ratios of whole texts grow with length and need limits by length; those of
    equal pieces hardly do, so their limits can be narrow.

    The limits given here are wide, for text of any kind; `PROSE` has those of the named queries.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (256, 1.10, 3.0),
        (1024, 1.25, 3.2),
        (4096, 1.40, 3.5),
        (16384, 1.50, 4.0),
    )
    chunk: int = 4096
    chunks: tuple[tuple[int, float, float], ...] = ((4096, 1.30, 3.4),)
    chunk_share: float = 0.5
    level: int = 3


#: Set by hand from the measured ratios of labelled prose, with a few percent of room. The limits suit
#: European languages in Latin script; `fit_bands` finds those of other texts.
PROSE = Bands(
    whole=(
        (256, 1.25, 1.95),
        (512, 1.40, 2.07),
        (1024, 1.60, 2.22),
        (2048, 1.75, 2.29),
        (4096, 1.90, 2.40),
        (8192, 2.00, 2.48),
        (16384, 2.10, 2.57),
        (32768, 2.15, 2.65),
        (65536, 2.20, 2.75),
    ),
    chunk=2048,
    chunks=((2048, 1.70, 2.16), (8192, 1.80, 2.15), (32768, 1.85, 2.15)),
)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, n_bytes long, ratio double, ratio_failed boolean, n_chunks long, n_chunks_out long, "
    "chunk_ratio double, chunks_failed boolean, kept boolean"
)
_RATIOS = ("ratio", "chunk_ratio")


def repeated_words(words: Words) -> np.ndarray:
    """Words per text that stand in a 3-word window found twice or more in that text."""
    h, owner = words.hashes, words.owner()
    covered = np.zeros(len(h), dtype=bool)
    if len(h) >= 3:
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        key = mix(mix(mix(h[inside]) + h[inside + 1]) + h[inside + 2])
        key = mix(key + owner[inside].astype(np.uint64))
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(key), dtype=bool)
        again[1:] |= same
        again[:-1] |= same
        hit = inside[order[again]]
        for step in range(3):
            covered[hit + step] = True
    return totals(covered, words.first)


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def limits(bands: tuple[tuple[int, float, float], ...], length: int) -> tuple[float, float]:
    """Lowest and highest ratio for a text of some length, which is not below the first entry."""
    return next((low, high) for least, low, high in reversed(bands) if length >= least)


def chunk_starts(length: int, size: int) -> list[int]:
    """First bytes of pieces of `size` bytes that cover all of a text; none for a shorter text."""
    if length < size:
        return []
    return [*range(0, length - size, size), length - size]


def measure(texts: Texts, bands: Bands) -> dict[str, np.ndarray]:
    """All measures of SCHEMA for some texts."""
    words = words_of(texts)
    n_words, repeats = words.counts, repeated_words(words)
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    packer = zstandard.ZstdCompressor(level=bands.level)
    n = len(texts)
    lines = np.zeros(n, np.int64)
    ratio, chunk_ratio = np.full(n, np.nan), np.full(n, np.nan)
    chunks, outside = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ratio_failed, chunks_failed = np.zeros(n, bool), np.zeros(n, bool)
    for i in range(n):
        text = texts.text(i)
        lines[i] = repeated_lines(text)
        if len(text) >= bands.whole[0][0]:
            ratio[i] = len(text) / len(packer.compress(text))
            low, high = limits(bands.whole, len(text))
            ratio_failed[i] = not low <= ratio[i] <= high
        if len(text) >= max(bands.chunk, bands.chunks[0][0]):
            starts = chunk_starts(len(text), bands.chunk)
            packed = np.array([bands.chunk / len(packer.compress(text[a : a + bands.chunk])) for a in starts])
            low, high = limits(bands.chunks, len(text))
            chunks[i], chunk_ratio[i] = len(packed), np.median(packed)
            outside[i] = np.count_nonzero((packed < low) | (packed > high))
            chunks_failed[i] = outside[i] > bands.chunk_share * chunks[i]
    return {
        "n_words": n_words,
        "word_chars": texts.per_text(~_NOT_INK),
        "n_symbols": texts.per_text(byte_class(SYMBOLS)),
        "n_dup_lines": lines,
        "n_repeat_words": repeats,
        "base_failed": failed,
        "n_bytes": np.diff(texts.offsets),
        "ratio": ratio,
        "ratio_failed": ratio_failed,
        "n_chunks": chunks,
        "n_chunks_out": outside,
        "chunk_ratio": chunk_ratio,
        "chunks_failed": chunks_failed,
        "kept": ~(failed | ratio_failed | chunks_failed),
    }


def quality_report(docs: DataFrame, bands: Bands = PROSE, id_col: str = "doc_id") -> DataFrame:
    """One row of measures and verdict per row, in one pass without a shuffle.

    A null text is empty; an empty text has no words and fails. `ratio` and
    `chunk_ratio` (median piece) are null for texts too short to judge, which no band rejects. Repeated rows give repeated reports; other columns are not read.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                found = measure(texts, bands)
                columns = [pa.array(v, mask=np.isnan(v) if k in _RATIOS else None) for k, v in found.items()]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], [id_col, *found])

    return docs.select(id_col, "text").mapInArrow(judge, f"`{id_col}` {key}, {SCHEMA}")


def keep_quality(docs: DataFrame, bands: Bands = PROSE) -> DataFrame:
    """The rows that pass, with all their columns unchanged."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                yield rows.filter(pa.array(measure(texts, bands)["kept"]))

    return docs.mapInArrow(passed, docs.schema)


def fit_bands(
    docs: DataFrame,
    labels: DataFrame,
    start: Bands = PROSE,
    margin: float = 0.02,
    id_col: str = "doc_id",
    label_col: str = "quality",
) -> Bands:
    """Bands that hold every text labelled 1, by doubling length, widened by `margin` on both sides.

    All labelled rows that are not held out and pass the base are measured; what reaches the driver is one
    row per power of two of the length. Lengths without such a text keep the limits of `start`.
    """
    good = labels.filter((F.col(label_col) == 1) & ~held_out(F.col(id_col))).select(F.col(id_col).alias("k")).distinct()
    report = quality_report(docs, start, id_col).filter("NOT base_failed")
    rows = (
        report.join(good, F.col(id_col) == F.col("k"), "left_semi")
        .groupBy(F.floor(F.log2("n_bytes")).cast("int").alias("power"))
        .agg(*(f(c).alias(f"{n}_{c}") for c in _RATIOS for n, f in (("low", F.min), ("high", F.max))))
        .collect()
    )

    def fitted(name: str, old: tuple[tuple[int, float, float], ...]) -> tuple[tuple[int, float, float], ...]:
        found = {
            1 << r["power"]: (r[f"low_{name}"] * (1 - margin), r[f"high_{name}"] * (1 + margin))
            for r in rows
            if r["power"] is not None and r[f"low_{name}"] is not None and 1 << r["power"] >= old[0][0]
        }
        steps = sorted({least for least, _, _ in old} | set(found))
        return tuple((least, *found.get(least, limits(old, least))) for least in steps)

    return replace(start, whole=fitted("ratio", start.whole), chunks=fitted("chunk_ratio", start.chunks))
