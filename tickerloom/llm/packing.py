"""Documents into sequences of a fixed number of tokens, by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.membership import fresh
from tickerloom.llm.words import WHITE, Texts, byte_values, span_hashes, text_slices, totals
from tickerloom.session import prepare

PIECES = "piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class PackRules:
    capacity: int = 2048
    #: Token put behind every document.
    end_id: int = 0
    #: Pieces that one task packs. A group leaves a few dozen sequences part-filled.
    group: int = 20_000


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Of lower-case text: 0 white space, 1 letter, 2 digit, 3 sign.
_KIND = np.full(256, 3, dtype=np.int8)
_KIND[list(WHITE)] = 0
_KIND[97:123] = _KIND[128:] = 1
_KIND[48:58] = 2


def _byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes are numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordTokens:
    """Token ids of texts, with every distinct string between two cuts encoded once.

    The tokenizer lower-cases, drops white space and cuts at runs of letters, at digits and at runs
    of signs, so the ids of a text are those of its runs in order. Texts of ASCII and Latin-1 letters
    are cut by array operations; other texts, and those that name a special token, go through the
    tokenizer as a whole. What is known is forgotten when it passes `most` strings.
    """

    def __init__(self, tokenizer_json: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(tokenizer_json)
        self._letters = _byte_letters()
        self._most = most
        self._forget()

    def _forget(self) -> None:
        # Sorted keys with the place of their ids: a few bytes a string, where a dict takes over a hundred.
        self._keys = np.zeros(0, dtype=np.uint64)
        self._begin = np.zeros(0, dtype=np.int64)
        self._size = np.zeros(0, dtype=np.int64)
        self._ids = np.zeros(1 << 16, dtype=np.uint32)
        self._used = 0

    def _learn(self, keys: np.ndarray, strings: list[bytes]) -> None:
        tokenize, letters = self._tokenizer.model.tokenize, self._letters
        found = [
            [t.id for t in tokenize(s.decode() if s.isascii() and s.isalnum() else "".join(letters[b] for b in s))]
            for s in strings
        ]
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        until = self._used + int(sizes.sum())
        if until > len(self._ids):
            grown = np.zeros(max(until, 2 * len(self._ids)), dtype=np.uint32)
            grown[: self._used] = self._ids[: self._used]
            self._ids = grown
        self._ids[self._used : until] = [i for f in found for i in f]
        at = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, at, keys)
        self._begin = np.insert(self._begin, at, self._used + np.cumsum(sizes) - sizes)
        self._size = np.insert(self._size, at, sizes)
        self._used = until

    def encode(self, texts: Texts) -> list[np.ndarray]:
        """Ids of each text."""
        data, before = texts.data, np.zeros(len(texts.data), np.uint8)
        before[1:] = data[:-1]
        high, after = data >= 0x80, before == 0xC3
        odd = high & (data != 0xC3) & ~(after & (data != 0x97) & (data != 0xB7))
        odd |= (data == ord("|")) & (before == ord("<"))
        plain = totals(odd, texts.offsets) == 0
        out: list[np.ndarray] = [None] * len(texts)  # type: ignore[list-item]
        for i in np.flatnonzero(~plain):
            whole = self._tokenizer.encode(texts.text(i).decode(), add_special_tokens=False)
            out[i] = np.array(whole.ids, dtype=np.uint32)
        own = np.flatnonzero(plain)
        if len(own) < len(texts):
            kept = [texts.text(i) for i in own]
            joined = np.frombuffer(b"".join(kept), dtype=np.uint8)
            texts = Texts(joined, np.concatenate([[0], np.cumsum([len(t) for t in kept])]).astype(np.int64))
        for i, ids in zip(own, self._encode_plain(texts)):
            out[i] = ids
        return out

    def _encode_plain(self, texts: Texts) -> list[np.ndarray]:
        data = _FOLD[texts.data]
        if not len(data):
            return [np.zeros(0, np.uint32)] * len(texts)
        small = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
        data[1:][small] += 32
        start, end = _runs(data, texts.offsets)
        key = span_hashes(byte_values()[data], start, end)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self._keys) > self._most:
            self._forget()
        at = np.searchsorted(self._keys, distinct)
        known = at < len(self._keys)
        known[known] = self._keys[at[known]] == distinct[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw, own = data.tobytes(), first[fresh]
            self._learn(distinct[fresh], [raw[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())])
        place = np.searchsorted(self._keys, distinct)[back]
        size = self._size[place]
        until = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(until[-1]) + np.repeat(self._begin[place] - until[:-1], size)
        return np.split(self._ids[take], until[np.searchsorted(start, texts.offsets[1:-1])])


def _runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of letters, digit and run of signs in lower-case text.

    A lone apostrophe takes the s, t, m, d, re, ve or ll that follows it.
    """
    kind = _KIND[data]
    cut = np.ones(len(data) + 1, dtype=bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut[offsets] = True
    at = np.flatnonzero(cut)
    start, end, what = at[:-1], at[1:].copy(), kind[at[:-1]]
    start, end = start[what > 0].copy(), end[what > 0]
    lone = np.flatnonzero((data[start] == ord("'")) & (end - start == 1))
    lone = lone[lone + 1 < len(start)]
    lone = lone[(start[lone + 1] == end[lone]) & (kind[start[lone + 1]] == 1) & ~np.isin(end[lone], offsets)]
    if len(lone):
        one = data[end[lone]]
        two = np.where(end[lone + 1] - start[lone + 1] > 1, data[np.minimum(end[lone] + 1, len(data) - 1)], 0)
        take = np.isin(one, list(b"stmd")).astype(np.int64)
        for pair in (b"re", b"ve", b"ll"):
            take[(one == pair[0]) & (two == pair[1])] = 2
        end[lone] += take
        start[lone + 1] += take
    held = end > start
    return start[held], end[held]


def token_pieces(
    docs: DataFrame, tokenizer_json: str, rules: PackRules = PackRules(), id_col: str = "doc_id", with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of whole texts, each followed by the end token.

    Only a document longer than the capacity is cut, into pieces of the capacity and a rest. A null
    or empty text is the end token alone. `tokenizer_json` is the content of a tokenizer file.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)
    key = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(vocabulary.value)
        for batch in batches:
            for rows, texts in text_slices(batch):
                row, columns, ids_out = [], [], []
                for i, ids in enumerate(tokens.encode(texts)):
                    ids = np.append(ids, np.uint32(rules.end_id)).astype("<u4")
                    for piece, a in enumerate(range(0, len(ids), rules.capacity)):
                        part = ids[a : a + rules.capacity]
                        row.append(i)
                        columns.append((piece, a, len(part), zlib.crc32(part.tobytes())))
                        if with_ids:
                            ids_out.append(part.astype(np.int32))
                table = np.array(columns, dtype=np.int64).reshape(-1, 4)
                arrays = [rows.column(0).take(pa.array(row, pa.int64())), pa.array(table[:, 0].astype(np.int32))]
                arrays += [pa.array(table[:, k]) for k in (1, 2, 3)]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(ids_out, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"`{id_col}` {key}, {PIECES}" + (", ids array<int>" if with_ids else "")
    return docs.select(id_col, "text").mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, taken in the given order.

    Of all open bins with room, and a new one, the choice is the one after which the sum over gaps
    of (open bins with that gap) squared is smallest; among equals the smallest gap. Full bins close.
    """
    held = np.zeros(capacity + 1, dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    none = np.iinfo(np.int64).max
    for i, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            counts = held[size:capacity]
            change = 1 - 2 * counts
            # The bin's new gap gains one, but a full bin is not open any more.
            change[1:] += 2 * held[1 : capacity - size] + 1
            change[counts == 0] = none
            best = int(change.argmin()) if len(change) else 0
            if len(change) and change[best] <= 2 * held[capacity - size] + 1:
                gap = size + best
        if gap < capacity:
            where = open_bins[gap].pop()
            held[gap] -= 1
        else:
            where, made = made, made + 1
        bins[i], offsets[i] = where, capacity - gap
        if gap > size:
            held[gap - size] += 1
            open_bins[gap - size].append(where)
    return bins, offsets


def pack(pieces: DataFrame, rules: PackRules = PackRules()) -> DataFrame:
    """The pieces with sequence_id and offset; lengths are 1 to the capacity, null lengths are refused.

    Pieces are dealt at random into groups of about `rules.group`, each packed by one task with the
    rule above in descending order of length. Equal rows are dealt apart by their place in the stored
    input, so that a row repeated often fills no group; a task that runs again deals alike. Groups do not
    share sequences, which costs some part-filled ones each.
    """
    prepare(pieces.sparkSession)
    pieces = pieces.checkpoint()
    total = pieces.count()
    groups = max(1, -(-total // rules.group))
    names, group = list(pieces.columns), fresh("__group", pieces)
    dealt = pieces.withColumn(group, F.pmod(F.xxhash64(*names, F.monotonically_increasing_id()), F.lit(groups)))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", *[c for c in names if c != "length"]], ascending=[False, *[True] * (len(names) - 1)])
        bins, offsets = sum_of_squares(frame["length"].to_numpy(), rules.capacity)
        return frame[names].assign(sequence_id=bins + (int(key[0]) << 32), offset=offsets)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy(group).applyInPandas(fill, f"{kept}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, tokenizer_json: str, rules: PackRules = PackRules(), id_col: str = "doc_id"
) -> DataFrame:
    """Tokenize, cut and pack: (id, piece, start, length, ids_crc32, sequence_id, offset)."""
    prepare(docs.sparkSession)
    return pack(token_pieces(docs, tokenizer_json, rules, id_col), rules)


def sequences(
    docs: DataFrame, tokenizer_json: str, rules: PackRules = PackRules(), id_col: str = "doc_id"
) -> DataFrame:
    """(sequence_id, ids): the packed token ids themselves, one row per sequence."""
    prepare(docs.sparkSession)
    pieces = token_pieces(docs, tokenizer_json, rules, id_col, with_ids=True).checkpoint()
    keys = [id_col, "piece", "start", "length", "ids_crc32"]
    # Repeated rows are packed as often as they occur; any of the equal pieces fills the place.
    numbered = F.row_number().over(_copies(keys))
    layout = pack(pieces.select(*keys), rules).withColumn("__copy", numbered)
    joined = layout.alias("l").join(
        pieces.withColumn("__copy", numbered).alias("p"),
        [F.col(f"l.{k}").eqNullSafe(F.col(f"p.{k}")) for k in (*keys, "__copy")],
    )
    gathered = joined.groupBy(F.col("l.sequence_id").alias("sequence_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("l.offset").alias("o"), F.col("p.ids").alias("ids")))).alias("parts")
    )
    return gathered.select("sequence_id", F.flatten(F.transform("parts", lambda s: s["ids"])).alias("ids"))


def _copies(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.lit(1))
