"""Words of whole Arrow text columns as 64-bit numbers, found with array operations.

A word is a run of bytes outside `\\x20\\x09-\\x0D`; in UTF-8 these are single bytes that occur in no
other character, so words of bytes are words of characters. Equal words get equal numbers in every
task and run. Texts are taken in slices of a few MB; one text longer than that is hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

WHITE = b" \t\n\x0b\x0c\r"
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def byte_values(lower: bool = False) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if lower:
        values[65:91] = values[97:123]
    return values


@cache
def byte_class(members: bytes) -> np.ndarray:
    """Truth table over byte values."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept and extended, at least one slice long."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        known = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _POWERS[base] = known
    return known[:n]


INVERSE = pow(_BASE, -1, 1 << 64)
#: Longest span that the polynomial names. Modulo 2^64 it takes equal values on a Thue-Morse sequence
#: of 1,024 places and on its complement; up to 64 places at least 38 bits tell such pairs apart.
POLYNOMIAL_SPAN = 64


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number for every span [start, end) of a sequence, equal for equal spans.

    Spans of up to 64 places by a polynomial, longer ones by xxh3 over their values.
    """
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(_BASE, len(values)), out=sums[1:])
    raw = (sums[end] - sums[start]) * powers(INVERSE, len(values) + 1)[start]
    out = mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    for i in np.flatnonzero(end - start > POLYNOMIAL_SPAN):
        out[i] = xxhash.xxh3_64_intdigest(values[start[i] : end[i]].tobytes(), seed=1)
    return out


@dataclass
class Texts:
    """Some whole texts: their bytes end to end, and where each begins."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_text(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in a byte class."""
        return totals(table[self.data], self.offsets)


def totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the flags between consecutive offsets."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def text_slices(
    batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Rows of a batch in order, in groups of about `size` bytes of text; a null text is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null("" if not pa.types.is_binary(values.type) else b"")
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)
    offsets = offsets[values.offset : values.offset + len(values) + 1]
    buffer = values.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(values):
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), len(values))
        own = offsets[row : end + 1]
        yield batch.slice(row, end - row), Texts(data[own[0] : own[-1]], own - own[0])
        row = end


@dataclass
class Words:
    """Numbers of all words, in order; `first[i]:first[i + 1]` are those of text i."""

    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def word_spans(
    texts: Texts, lower: bool = False, separators: bytes = WHITE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, first bytes and ends of all runs of bytes outside the separators, in order.

    `lower` treats A-Z as a-z; other letters keep their case.
    """
    white, values = byte_class(separators), byte_values(lower)
    begins = np.zeros(len(texts.data) + 1, dtype=bool)
    begins[texts.offsets] = True
    found = [np.zeros(0, np.uint64)]
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, size = 0, len(texts.data)
    while at < size:
        end = min(at + SLICE_BYTES, size)
        while end < size and not (begins[end] or white[texts.data[end]]):
            end += 1
        block = texts.data[at:end]
        inked = ~white[block]
        opens, closes = inked.copy(), inked.copy()
        opens[1:] &= ~inked[:-1] | begins[at + 1 : end]
        closes[:-1] &= ~inked[1:] | begins[at + 1 : end]
        start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        found.append(span_hashes(values[block], start, stop))
        starts.append(start + at)
        ends.append(stop + at)
        at = end
    return np.concatenate(found), np.concatenate(starts), np.concatenate(ends)


def words_of(texts: Texts, lower: bool = False, separators: bytes = WHITE) -> Words:
    hashes, start, _ = word_spans(texts, lower, separators)
    return Words(hashes, np.searchsorted(start, texts.offsets))
