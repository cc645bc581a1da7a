"""Benchmark passages in training text, by suffix arrays of the text.

The training side is cut into shards: the words of some whole documents, or an overlapping part of a
very long one. Each task sorts the suffixes of a shard into an array and looks every suffix of the
test side up in it, one word after the other by binary search, so the range of places that share the
first n words is known for each n. The range at the window's length says where the window occurs, and
the last range that is not empty gives the longest verbatim match. Documents never leave their row,
so nothing is shuffled.

Nulls, empty texts and texts of separators have no words: nothing occurs in them, nothing of them
occurs elsewhere. Equal rows are judged alike, one result each. A null item id is written as an empty
string; rows that repeat an item id count as one item. Empty tables give no rows, or no matches. A
text longer than a shard is searched in overlapping shards with the same result. Further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.llm.words import Texts, text_slices, words_of
from tickerloom.session import prepare

#: Between words, once A-Z count as a-z: all ASCII but digits and letters.
SEPARATORS = bytes([*range(48), *range(58, 65), *range(91, 97), *range(123, 128)])


@dataclass(frozen=True)
class LeakRules:
    #: Words of a test item that make a window; a shorter item is one window.
    window: int = 10
    #: Text whose suffixes are sorted together.
    shard_bytes: int = 4 << 20
    shard_words: int = 1 << 20
    #: Test texts that are broadcast at once. More go in further passes over the documents.
    block_bytes: int = 32 << 20


@dataclass
class Probe:
    """Suffixes of some test items: the words from `at` to `end` in `words`, where 0 ends an item."""

    words: np.ndarray
    at: np.ndarray
    end: np.ndarray
    item: np.ndarray
    #: Length of the window at each suffix, and which distinct window it is.
    window: np.ndarray
    window_id: np.ndarray
    #: Sorted distinct item ids; windows with the same items share a list of them.
    ids: list[str]
    list_of: np.ndarray
    lists: list[np.ndarray]

    @property
    def longest(self) -> int:
        return int((self.end - self.at).max(initial=1))


def _joined(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers with a 0 behind each text, and where each text begins."""
    counts = np.diff(first)
    begin = first[:-1] + np.arange(len(counts))
    out = np.zeros(len(words) + len(counts), dtype=np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)] = words
    return out, begin


def make_probe(items: list[tuple[str, str]], rules: LeakRules) -> Probe:
    """From (item id, text) pairs."""
    data = [text.encode("utf-8", "surrogatepass") for _, text in items]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    found = words_of(Texts(np.frombuffer(b"".join(data), dtype=np.uint8), offsets), True, SEPARATORS)
    words, begin = _joined(found.hashes, found.first)
    counts = found.counts
    suffixes = np.where(counts == 0, 0, np.maximum(counts - rules.window, 0) + 1)
    owner = np.repeat(np.arange(len(items)), suffixes)
    at = begin[owner] + np.arange(len(owner)) - (np.cumsum(suffixes) - suffixes)[owner]
    end = begin[owner] + counts[owner]
    window = np.minimum(end - at, rules.window)
    padded = np.concatenate([words, np.zeros(rules.window, np.uint64)])
    table = padded[at[:, None] + np.arange(rules.window)]
    table[np.arange(rules.window) >= window[:, None]] = 0
    ids = sorted({i for i, _ in items})
    number = {v: k for k, v in enumerate(ids)}
    item = np.array([number[i] for i, _ in items], dtype=np.int64)[owner]
    if not len(at):
        none = np.zeros(0, np.int64)
        return Probe(words, none, none, none, none, none, ids, none, [])
    window_id = np.unique(table, axis=0, return_inverse=True)[1].reshape(-1)
    pairs = np.unique(np.stack([window_id, item], axis=1), axis=0)
    cuts = np.searchsorted(pairs[:, 0], np.arange(1, window_id.max() + 1))
    known: dict[bytes, int] = {}
    lists: list[np.ndarray] = []
    list_of = np.zeros(window_id.max() + 1, dtype=np.int64)
    for w, members in enumerate(np.split(pairs[:, 1], cuts)):
        k = known.setdefault(members.tobytes(), len(lists))
        if k == len(lists):
            lists.append(members)
        list_of[w] = k
    return Probe(words, at, end, item, window, window_id, ids, list_of, lists)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Where the suffixes begin, in the order of their first `depth` words at least.

    Prefix doubling: suffixes in the order of k words and of the k words behind them are in the order
    of 2k words. Only those that share their first k words with another are sorted again. A 0 ends a
    text: what follows it has no order, and suffixes that begin with it come first.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    keys, places = words[order], np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    at, k = places[np.searchsorted(keys, 1) :], 1
    rank[order[: n - len(at)]] = 0
    keys = keys[n - len(at) :]
    while True:
        new = np.ones(len(at), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        rank[order[at]] = np.repeat(at[first], size)
        at = at[np.repeat(size > 1, size)]
        if k >= depth or not len(at):
            return order
        begin = order[at]
        behind = begin + k
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)] + 1, 0)
        keys = rank[begin].astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        moved = np.argsort(keys, kind="stable")
        order[at], keys, k = begin[moved], keys[moved], 2 * k


def _bound(words, order, low, high, depth, want, right):
    """Binary search in many ranges at once: the first place not below (or, right, above) the word."""
    low, high = low.copy(), high.copy()
    while True:
        left = np.flatnonzero(low < high)
        if not len(left):
            return low
        middle = (low[left] + high[left]) >> 1
        value = words[order[middle] + depth]
        up = value <= want[left] if right else value < want[left]
        low[left[up]] = middle[up] + 1
        high[left[~up]] = middle[~up]


@dataclass
class Found:
    """Per suffix of the test side: range of places that hold its window, and its longest match."""

    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    place: np.ndarray


def search(words: np.ndarray, order: np.ndarray, probe: Probe) -> Found:
    m = len(probe.at)
    out = Found(*(np.zeros(m, dtype=np.int64) for _ in range(4)))
    live = np.arange(m)
    firsts = words[order]
    want = probe.words[probe.at]
    low, high = np.searchsorted(firsts, want), np.searchsorted(firsts, want, side="right")
    padded = np.concatenate([words, np.zeros(probe.longest + 1, np.uint64)])
    depth = 0
    while True:
        same = low < high
        live, low, high = live[same], low[same], high[same]
        depth += 1
        out.length[live] = depth
        out.place[live] = order[low]
        whole = probe.window[live] == depth
        out.low[live[whole]], out.high[live[whole]] = low[whole], high[whole]
        more = probe.at[live] + depth < probe.end[live]
        live, low, high = live[more], low[more], high[more]
        if not len(live):
            return out
        want = probe.words[probe.at[live] + depth]
        low, high = (
            _bound(padded, order, low, high, depth, want, False),
            _bound(padded, order, low, high, depth, want, True),
        )


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges end to end, and the range of each."""
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(len(owner)) - (np.cumsum(size) - size)[owner] + low[owner], owner


def _shards(words: np.ndarray, longest: int, rules: LeakRules) -> Iterator[tuple[int, np.ndarray]]:
    """(first place, words); consecutive shards overlap by one word less than the longest item."""
    at = 0
    while True:
        yield at, words[at : at + rules.shard_words + longest]
        at += rules.shard_words
        if at >= len(words):
            return


def _merged(marks: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of the runs of true marks."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _hits_of(texts: Texts, probe: Probe, rules: LeakRules):
    """Per text: number of words, spans of hit words, numbers of the items that occur."""
    found = words_of(texts, True, SEPARATORS)
    words, begin = _joined(found.hashes, found.first)
    marks = np.zeros(len(words) + 1, dtype=np.int64)
    lists = [np.zeros((0, 2), np.int64)]
    one_each = np.unique(probe.window_id, return_index=True)[1]
    for base, shard in _shards(words, probe.longest, rules) if len(one_each) else ():
        order = suffix_array(shard, probe.longest)
        hits = search(shard, order, probe)
        slots, owner = _ranges(hits.low[one_each], hits.high[one_each])
        place = order[slots] + base
        np.add.at(marks, place, 1)
        np.add.at(marks, place + probe.window[one_each][owner], -1)
        text = np.searchsorted(begin, place, side="right") - 1
        lists.append(np.unique(np.stack([text, probe.list_of[owner]], axis=1), axis=0))
    hit = np.cumsum(marks[:-1]) > 0
    listed = np.unique(np.concatenate(lists), axis=0)
    cuts = np.searchsorted(listed[:, 0], np.arange(len(texts) + 1))
    for i, count in enumerate(found.counts):
        own = listed[cuts[i] : cuts[i + 1], 1]
        items = np.unique(np.concatenate([probe.lists[k] for k in own])) if len(own) else own
        yield int(count), _merged(hit[begin[i] : begin[i] + count]), items


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _blocks(bench: DataFrame, rules: LeakRules) -> Iterator[list[tuple[str, str]]]:
    """Test items in groups of about `block_bytes`; the driver holds one group at a time."""
    items = bench.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = total // rules.block_bytes + 1
    if groups == 1:
        yield [(r["item"], r["text"]) for r in items.collect()]
        return
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(groups)))
    for g in range(groups):
        yield [(r["item"], r["text"]) for r in dealt.filter(F.col("part") == g).collect()]


def scan_leaks(docs: DataFrame, bench: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """Per document: doc_id, n_words, `spans` of hit words ([start, end), merged, in order) and `items`,
    the sorted ids of the test items whose windows occur in it.

    `docs` has doc_id and text, `bench` item_id and text. One pass over the documents for every
    `block_bytes` of test text.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    fields = [
        rows.schema["doc_id"],
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", _SPANS),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
    blocks = _blocks(bench, rules)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        held = spark.sparkContext.broadcast(make_probe(block, rules))
        keep_text = following is not None

        def scan(batches, held=held, keep_text=keep_text):
            probe = held.value
            for batch in batches:
                for part, texts in text_slices(batch, size=rules.shard_bytes):
                    n_words, spans, items = [], [], []
                    for n, own, listed in _hits_of(texts, probe, rules):
                        n_words.append(n)
                        spans.append(own)
                        items.append([probe.ids[k] for k in listed])
                    if "spans" in part.schema.names:
                        earlier = part.column("spans").to_pylist()
                        spans = [_union([(s["start"], s["end"]) for s in e], own) for e, own in zip(earlier, spans)]
                        items = [sorted({*e, *own}) for e, own in zip(part.column("items").to_pylist(), items)]
                    spans = [[{"start": a, "end": b} for a, b in own] for own in spans]
                    columns = [
                        part.column("doc_id"),
                        pa.array(n_words, pa.int64()),
                        pa.array(spans, _ARROW_SPANS),
                        pa.array(items, pa.list_(pa.string())),
                    ]
                    names = ["doc_id", "n_words", "spans", "items"]
                    if keep_text:
                        columns.append(part.column("text"))
                        names.append("text")
                    yield pa.RecordBatch.from_arrays(columns, names)

        text = [T.StructField("text", T.StringType())] if keep_text else []
        rows = rows.mapInArrow(scan, T.StructType([*fields, *text]))
        if keep_text:
            # The next pass begins from a stored table, with one group of test items in memory.
            rows = rows.checkpoint()
        block = following
    return rows


def remove_leaks(docs: DataFrame, bench: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """The documents, with all their columns, in which no window of a test item occurs."""
    spark = prepare(docs.sparkSession)
    rows = docs
    for block in _blocks(bench, rules):
        held = spark.sparkContext.broadcast(make_probe(block, rules))

        def clean(batches, held=held):
            for batch in batches:
                for part, texts in text_slices(batch, size=rules.shard_bytes):
                    kept = [not spans for _, spans, _ in _hits_of(texts, held.value, rules)]
                    yield part.filter(pa.array(kept, pa.bool_()))

        rows = rows.mapInArrow(clean, docs.schema)
    return rows


def longest_matches(docs: DataFrame, bench: DataFrame, rules: LeakRules = LeakRules()) -> DataFrame:
    """(item_id, item_start, length, doc_id, doc_start): for every suffix of a test item whose window
    occurs, its longest verbatim match over all documents; of equal ones that with the smallest doc_id,
    then the first. Starts and lengths are in words. doc_id is a long."""
    spark = prepare(docs.sparkSession)
    schema = "item_id string, item_start long, length long, doc_id long, doc_start long"
    found = None
    for block in _blocks(bench, rules):
        held = spark.sparkContext.broadcast(make_probe(block, rules))

        def match(batches, held=held):
            probe = held.value
            begins = np.searchsorted(np.flatnonzero(probe.words == 0), probe.at)
            item_begin = np.concatenate([[0], np.flatnonzero(probe.words == 0) + 1])[begins]
            for batch in batches:
                for part, texts in text_slices(batch, size=rules.shard_bytes):
                    own = words_of(texts, True, SEPARATORS)
                    words, begin = _joined(own.hashes, own.first)
                    doc_ids = part.column("doc_id").to_pylist()
                    for base, shard in _shards(words, probe.longest, rules) if len(probe.at) else ():
                        order = suffix_array(shard, probe.longest)
                        hits = search(shard, order, probe)
                        # All places of the longest match, so that ties are settled the same way anywhere.
                        best: dict[int, tuple] = {}
                        for j in np.flatnonzero(hits.length >= probe.window):
                            best[int(j)] = _first_place(shard, order, hits, probe, int(j), base, begin, doc_ids)
                        if best:
                            js = np.fromiter(best, dtype=np.int64)
                            yield pa.RecordBatch.from_pydict(
                                {
                                    "item_id": [probe.ids[k] for k in probe.item[js]],
                                    "item_start": pa.array((probe.at - item_begin)[js]),
                                    "length": pa.array(hits.length[js]),
                                    "doc_id": pa.array([best[int(j)][0] for j in js], pa.int64()),
                                    "doc_start": pa.array([best[int(j)][1] for j in js], pa.int64()),
                                }
                            )

        part = docs.select("doc_id", "text").mapInArrow(match, schema)
        found = part if found is None else found.union(part)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_start")
    return (
        found.groupBy("item_id", "item_start", "length")
        .agg(F.min(least).alias("p"))
        .groupBy("item_id", "item_start")
        .agg(F.max_by(F.struct("length", "p"), "length").alias("best"))
        .select("item_id", "item_start", "best.length", "best.p.doc_id", "best.p.doc_start")
    )


def _first_place(shard, order, hits, probe, j, base, begin, doc_ids):
    """(doc_id, word) of the smallest document, then first place, that holds suffix j's longest match."""
    places = order[hits.low[j] : hits.high[j]]
    pattern = probe.words[probe.at[j] : probe.at[j] + hits.length[j]]
    padded = np.concatenate([shard, np.zeros(len(pattern), np.uint64)])
    for d in range(int(probe.window[j]), len(pattern)):
        places = places[padded[places + d] == pattern[d]]
    text = np.searchsorted(begin, places + base, side="right") - 1
    keyed = [(doc_ids[t] is None, doc_ids[t] or 0, int(p + base - begin[t])) for t, p in zip(text, places)]
    none, doc_id, at = min(keyed)
    return (None if none else doc_id), at
