"""Long repeats across documents, found by recompression and removed but for their first place.

Every document is parsed in rounds. The first names runs of one word, the others pairs: a bit of each
symbol says whether it is a left or a right one, and a left one followed by a right one become one
symbol; equal neighbours never do. Names are hashes of what they stand for, so they agree in all documents without any
exchange, and whether two symbols join depends on these two only. Equal stretches of text therefore
get equal symbols, but for some at their ends; every symbol knows the stretch of words that decides
it. The longest symbol that a window of words decides alone stands for that window: equal windows
have equal ones. Only windows whose symbol occurs twice or more in the corpus are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.llm.membership import bit_array, bitmap, in_bits, maybe_members
from tickerloom.llm.words import Texts, Words, mix, span_hashes, text_slices, words_of
from tickerloom.session import brief_shuffles, prepare


@dataclass(frozen=True)
class RepeatRules:
    #: Words of the windows that count as repeats.
    window: int = 20
    #: Rounds of pairs; each shortens a text by about a quarter.
    rounds: int = 4


@dataclass
class Symbols:
    """A parse: names, first word, number of words, and the words [low, high) that decide a symbol."""

    name: np.ndarray
    start: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    owner: np.ndarray
    first: np.ndarray

    def take(self, keep: np.ndarray) -> Symbols:
        own = (getattr(self, f)[keep] for f in ("name", "start", "size", "low", "high", "owner"))
        return Symbols(*own, self.first)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Where the words that decide the left neighbour begin and those of the right one end. At the
        ends of a text that is one word outside of it, where no window of the text reaches. Both
        never fall along a parse."""
        left, right = self.first[self.owner] - 1, self.first[self.owner + 1] + 1
        same = self.owner[1:] == self.owner[:-1]
        left[1:][same] = self.low[:-1][same]
        right[:-1][same] = self.high[1:][same]
        return left, right


def _name_runs(s: Symbols) -> Symbols:
    if not len(s.name):
        return s
    opens = np.ones(len(s.name), dtype=bool)
    opens[1:] = (s.name[1:] != s.name[:-1]) | (s.owner[1:] != s.owner[:-1])
    at = np.flatnonzero(opens)
    if len(at) == len(s.name):
        # No run, but each symbol's neighbours have shown that.
        times = np.ones(len(at), dtype=np.int64)
    else:
        times = np.diff(np.append(at, len(s.name)))
    left, right = s.neighbours()
    last = at + times - 1
    out = s.take(at)
    many = times > 1
    out.name[many] = mix(out.name[many] + mix(times[many].astype(np.uint64)))
    out.size = s.start[last] + s.size[last] - s.start[at]
    # A run ends where its neighbours differ from it. A lone symbol differs from them as well.
    out.low = np.minimum(s.low[at], left[at])
    out.high = np.maximum(s.high[last], right[last])
    return out


def _name_pairs(s: Symbols, level: int) -> Symbols:
    if not len(s.name):
        return s
    right_kind = (mix(s.name + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(s.name), dtype=bool)
    joins[:-1] = ~right_kind[:-1] & right_kind[1:] & (s.owner[1:] == s.owner[:-1])
    left, right = s.neighbours()
    second = np.zeros(len(s.name), dtype=bool)
    second[1:] = joins[:-1]
    # Alone: a left one because its right neighbour is not a right one, and the other way round.
    alone = ~joins & ~second
    low = np.where(alone & right_kind, np.minimum(s.low, left), s.low)
    high = np.where(alone & ~right_kind, np.maximum(s.high, right), s.high)
    first = np.flatnonzero(joins)
    name, size = s.name.copy(), s.size.copy()
    name[first] = mix(mix(s.name[first] + np.uint64(level + 7)) + s.name[first + 1])
    size[first] += s.size[first + 1]
    low[first] = np.minimum(s.low[first], s.low[first + 1])
    high[first] = np.maximum(s.high[first], s.high[first + 1])
    return Symbols(name, s.start, size, low, high, s.owner, s.first).take(~second)


def parse(words: Words, rounds: int) -> Symbols:
    n = np.arange(len(words.hashes))
    s = Symbols(words.hashes, n, np.ones(len(n), np.int64), n, n + 1, words.owner(), words.first)
    s = _name_runs(s)
    for level in range(rounds):
        s = _name_pairs(s, level)
    return s


@dataclass
class Windows:
    """All windows of some texts: first word (in the slice), text, anchor name and place, content."""

    start: np.ndarray
    owner: np.ndarray
    anchor: np.ndarray
    place: np.ndarray
    content: np.ndarray


def windows_of(words: Words, rules: RepeatRules) -> Windows:
    size = rules.window
    counts = words.counts
    many = np.maximum(counts - size + 1, 0)
    owner = np.repeat(np.arange(len(counts)), many)
    start = np.arange(int(many.sum())) + np.repeat(words.first[:-1] - (np.cumsum(many) - many), many)
    content = span_hashes(words.hashes, start, start + size)
    s = parse(words, rules.rounds)
    # Longer symbols first, then by name: one number that is compared and kept as the anchor's name.
    rank = (np.minimum(s.size, 255).astype(np.uint64) << np.uint64(56)) | (mix(s.name) >> np.uint64(8))
    first = np.searchsorted(s.low, start, side="left")
    last = np.searchsorted(s.high, start + size, side="right") - 1
    place = _leftmost_largest(rank, first, last)
    seen = place >= 0
    # A window that decides no symbol stands for itself.
    anchor = mix(content) >> np.uint64(8)
    anchor[seen] = rank[place[seen]]
    place = np.where(seen, place, -1 - start)
    return Windows(start, owner, mix(anchor), place, content)


def _leftmost_largest(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the largest rank in [first, last], the leftmost of equals; -1 where that is empty."""
    out = np.full(len(first), -1, dtype=np.int64)
    length = last - first + 1
    table = np.arange(len(rank))
    step = 1
    while True:
        own = np.flatnonzero((length >= step) & (length < 2 * step))
        a, b = table[first[own]], table[last[own] - step + 1]
        out[own] = np.where(rank[a] >= rank[b], a, b)
        if not (length >= 2 * step).any():
            return out
        a, b = table[:-step], table[step:]
        table = np.where(rank[a] >= rank[b], a, b)
        step *= 2


def whole_copies(docs: DataFrame, id_col: str, rules: RepeatRules) -> DataFrame:
    """(id) of documents whose words equal those of one with a smaller id, at least one window long.

    The topmost symbol of a parse is the whole document: these need no windows.
    """
    key = docs.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                words = words_of(texts)
                begin, end = words.first[:-1], words.first[1:]
                a = span_hashes(words.hashes, begin, end)
                b = span_hashes(mix(words.hashes + np.uint64(1)), begin, end)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(words.counts), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))],
                    ["id", "n", "a", "b"],
                )

    whole = docs.select(id_col, "text").mapInArrow(digest, f"id {key}, n long, a long, b long")
    whole = whole.filter(F.col("n") >= rules.window).checkpoint()
    first = whole.groupBy("n", "a", "b").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    return whole.join(first, ["n", "a", "b"]).filter(F.col("id") > F.col("first")).select("id").distinct()


def _without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not listed; only rows that may be listed are shuffled."""
    bits = bitmap(ids, F.col("id")).checkpoint()
    maybe = maybe_members(docs, F.col(id_col), bits)
    rest = maybe.join(ids, F.col(id_col) == F.col("id"), "left_anti")
    return maybe_members(docs, F.col(id_col), bits, absent=True).unionByName(rest)


def _anchor_names(docs: DataFrame, rules: RepeatRules) -> DataFrame:
    """(name) once per place that stands for at least one window."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_slices(batch):
                w = windows_of(words_of(texts), rules)
                fresh = np.ones(len(w.place), dtype=bool)
                fresh[1:] = w.place[1:] != w.place[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(w.anchor[fresh].view(np.int64))], ["name"])

    return docs.select("text").mapInArrow(emit, "name long")


def repeated_starts(docs: DataFrame, id_col: str, rules: RepeatRules) -> DataFrame:
    """(id, start) of each window whose words also start earlier; ids are unique and not null."""
    spark, key = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    names = _anchor_names(docs, rules).groupBy("name").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = spark.sparkContext.broadcast(bit_array(names, "name"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                words = words_of(texts)
                w = windows_of(words, rules)
                on = np.flatnonzero(in_bits(shared.value, w.anchor))
                owner = w.owner[on]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(owner)),
                        pa.array((w.start[on] - words.first[owner]).astype(np.int32)),
                        pa.array(w.content[on].view(np.int64)),
                        pa.array((w.anchor[on] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    ],
                    ["id", "start", "content", "anchor"],
                )

    columns = f"id {key}, start int, content long, anchor int"
    windows = docs.select(id_col, "text").mapInArrow(emit, columns)
    # Equal windows meet in order of place, so they are sent once; rows that tie with the first are not later.
    place = F.rank().over(Window.partitionBy("content", "anchor").orderBy("id", "start"))
    return windows.withColumn("place", place).filter("place > 1").select("id", "start")


def removals(docs: DataFrame, id_col: str = "doc_id", rules: RepeatRules = RepeatRules()) -> DataFrame:
    """(id, starts array<int>, whole boolean): what is to be taken out of which document."""
    copies = whole_copies(docs, id_col, rules).checkpoint()
    rest = _without(docs, id_col, copies)
    starts = repeated_starts(rest, id_col, rules).groupBy("id").agg(F.collect_list("start").alias("starts"))
    return starts.withColumn("whole", F.lit(False)).unionByName(
        copies.select("id", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    )


def _kept(text: bytes, starts, whole: bool, window: int) -> tuple[list[bytes], int]:
    """Words that stay, and how many there were."""
    words = text.split()
    if whole:
        return [], len(words)
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.unique(np.asarray(starts, dtype=np.int64))
    np.add.at(gone, starts, 1)
    np.add.at(gone, np.minimum(starts + window, len(words)), -1)
    covered = np.cumsum(gone)[:-1] > 0
    return [w for w, c in zip(words, covered) if not c], len(words)


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", rules: RepeatRules = RepeatRules(), with_text: bool = False
) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256[, text]; kept words are joined by one space.

    A word goes if it is covered by a window of `rules.window` words whose words also start earlier, at
    a smaller id or earlier in the same document; windows are judged on the input. Null and empty texts
    have no words. Ids are unique; rows that repeat an id are cleaned alike, by what is found for any
    of them. A row with a null id is kept whole and is not a source of repeats. Other columns are
    not read.
    """
    prepare(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    known = docs.select(id_col, "text").filter(F.col(id_col).isNotNull())
    with brief_shuffles(docs.sparkSession):
        gone = removals(known, id_col, rules).checkpoint()
        bits = bitmap(gone, F.col("id")).checkpoint()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                starts = rows.column(2).to_pylist() if rows.num_columns > 2 else None
                whole = rows.column(3).to_pylist() if starts is not None else None
                out = []
                for i in range(len(texts)):
                    text = texts.text(i)
                    if starts is None:
                        left = text.split()
                        n = len(left)
                    else:
                        left, n = _kept(text, starts[i] or [], bool(whole[i]), rules.window)
                    kept = b" ".join(left)
                    out.append((n, n - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
                n, removed, sha, kept = zip(*out)
                columns = [rows.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
                names = [id_col, "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(kept, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {key}, n_words long, n_removed long, kept_sha256 string" + (", text string" if with_text else "")
    rows = docs.select(id_col, "text")
    untouched = maybe_members(rows, F.col(id_col), bits, absent=True).mapInArrow(clean, schema)
    touched = maybe_members(rows, F.col(id_col), bits).join(gone, F.col(id_col) == F.col("id"), "left")
    return untouched.unionByName(touched.select(id_col, "text", "starts", "whole").mapInArrow(clean, schema))
