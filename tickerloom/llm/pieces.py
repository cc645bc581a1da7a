"""Unigram segmentation into pieces: Viterbi over a double-array trie, byte fallback, decoding."""

from __future__ import annotations

import hashlib
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickerloom.llm.words import Texts, byte_values, span_hashes, text_slices

#: The marker U+2581 that stands for a space inside pieces.
MARKER = "▁".encode()
#: Score of a character without a piece, below the worst piece.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Trie:
    """Double array: from node s, byte c leads to t = base[s] + c + 1 if check[t] == s.

    `value[t]` is the piece that ends at node t, or -1. The arrays are padded so that no lookup
    leaves them.
    """

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Next node, or -1; a node of -1 stays there."""
        to = self.base[node] + byte + 1
        return np.where((node >= 0) & (self.check[to] == node), to, -1)


def build_trie(keys: list[bytes], values: list[int]) -> Trie:
    """Nodes are placed breadth first at the first base where all their children fit."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in zip(keys, values):
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        ends[node] = value
    size = 2 * len(children) + 65_536
    base, check = np.zeros(size, np.int32), np.full(size, -2, np.int32)
    found = np.full(size, -1, np.int32)
    free = np.ones(size, dtype=bool)
    free[0] = False
    found[0] = ends[0]
    low = 257
    queue = deque([(0, 0)])
    while queue:
        node, at = queue.popleft()
        codes = np.array(sorted(children[node]), dtype=np.int64) + 1
        if not len(codes):
            continue
        if low + 16_384 > len(free):
            base, found = (np.concatenate([a, np.full(len(free), fill, np.int32)]) for a, fill in ((base, 0), (found, -1)))
            check = np.concatenate([check, np.full(len(free), -2, np.int32)])
            free = np.concatenate([free, np.ones(len(free), dtype=bool)])
        while not free[low]:
            low += 1
        begin = low - int(codes[0])
        while len(codes) > 1:
            # Slots behind the first free one for the first child, then the one where all others fit.
            slots = begin + np.flatnonzero(free[begin + codes[0] : begin + codes[0] + 512])
            fits = free[slots[:, None] + codes[None, 1:]].all(axis=1)
            if fits.any():
                begin = int(slots[fits.argmax()])
                break
            begin += 512
            if begin + 1024 > len(free):
                raise ValueError("too many pieces share a prefix")
        base[at] = begin
        for byte, child in children[node].items():
            to = begin + byte + 1
            free[to] = False
            check[to], found[to] = at, ends[child]
            queue.append((child, to))
    pad = 512
    return Trie(
        np.concatenate([base, np.zeros(pad, np.int32)]),
        np.concatenate([check, np.full(pad, -2, np.int32)]),
        np.concatenate([found, np.full(pad, -1, np.int32)]),
    )


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. `text[i]` is what piece i adds to a decoded text; marker pieces are spaces."""

    trie: Trie
    score: np.ndarray
    byte_id: np.ndarray
    text: list[bytes]
    longest: int

    @staticmethod
    def make(pieces: list[tuple[str, float, str]]) -> Vocabulary:
        """From (piece, log score, kind) in order of id; kinds: normal, byte, other. Byte pieces are
        written `<0x00>` to `<0xFF>` and all 256 must be there."""
        keys, values = [], []
        byte_id, text = np.full(256, -1, np.int32), []
        for i, (piece, _, kind) in enumerate(pieces):
            raw = piece.encode()
            if kind == "byte":
                byte_id[int(piece[3:5], 16)] = i
                text.append(bytes([int(piece[3:5], 16)]))
            elif kind == "normal":
                keys.append(raw.replace(MARKER, b" "))
                values.append(i)
                text.append(keys[-1])
            else:
                text.append(b"")
        if (byte_id < 0).any():
            raise ValueError("a vocabulary without all byte pieces cannot encode every text")
        score = np.array([s for _, s, _ in pieces], dtype=float)
        return Vocabulary(build_trie(keys, values), score, byte_id, text, max(map(len, keys), default=1))

    @property
    def unknown(self) -> float:
        used = self.trie.value[self.trie.value >= 0]
        return (float(self.score[used].min()) if len(used) else 0.0) - UNKNOWN_PENALTY


def read_vocabulary(model_file: str) -> Vocabulary:
    """Pieces and scores of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kind = lambda i: (
        "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
    )
    return Vocabulary.make([(model.id_to_piece(i), model.get_score(i), kind(i)) for i in range(model.get_piece_size())])


def viterbi(vocabulary: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best split of each segment `data[start:end]`, end to end, and how many each has.

    The sum of log scores is largest; among equal sums the last piece that starts earliest wins. A
    character that no piece of one character covers may be passed at the unknown score and becomes
    its bytes. Segments of similar length are split together, in step.
    """
    sizes = end - start
    order = np.argsort(sizes, kind="stable")
    ids: list[np.ndarray] = []
    counts = np.zeros(len(sizes), dtype=np.int64)
    at = 0
    while at < len(order):
        width = max(int(sizes[order[at]]) + 4, int(sizes[order[at]]) * 5 // 4)
        until = int(np.searchsorted(sizes[order], width, side="right"))
        until = min(until, at + max(1, 2_000_000 // width))
        own = order[at:until]
        flat, counts[own] = _viterbi_block(vocabulary, data, start[own], sizes[own])
        ids.append(flat)
        at = until
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    # Back from the order of lengths to the given order.
    held = counts[order]
    begin = np.empty(len(order), dtype=np.int64)
    begin[order] = np.cumsum(held) - held
    return flat[ranges(begin, counts)], counts


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .., then the same for each further range."""
    until = np.cumsum(size)
    return np.arange(until[-1] if len(until) else 0) + np.repeat(begin - (until - size), size)


def _viterbi_block(vocabulary: Vocabulary, text: np.ndarray, begin: np.ndarray, sizes: np.ndarray):
    n, width = len(sizes), int(sizes.max())
    data = np.zeros((n, width), dtype=np.int32)
    data[np.repeat(np.arange(n), sizes), ranges(np.zeros(n, np.int64), sizes)] = text[ranges(begin, sizes)]
    best = np.full((n, width + 5), -np.inf)
    best[:, 0] = 0
    came = np.zeros((n, width + 5), dtype=np.int32)
    piece = np.full((n, width + 5), -1, dtype=np.int32)
    trie, unknown = vocabulary.trie, vocabulary.unknown
    for start in range(width):
        lead = data[:, start]
        rows = np.flatnonzero((start < sizes) & ((lead & 0xC0) != 0x80))
        if not len(rows):
            continue
        first = lead[rows]
        char = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        node, live, covered = np.zeros(len(rows), np.int32), np.arange(len(rows)), np.zeros(len(rows), dtype=bool)
        for length in range(1, min(vocabulary.longest, width - start) + 1):
            own = rows[live]
            node = trie.step(node, data[own, start + length - 1])
            on = (node >= 0) & (start + length <= sizes[own])
            live, node, own = live[on], node[on], own[on]
            if not len(live):
                break
            value = trie.value[node]
            ends = value >= 0
            if ends.any():
                who, ids = own[ends], value[ends]
                covered[live[ends]] |= char[live[ends]] == length
                _improve(best, came, piece, who, start, length, best[who, start] + vocabulary.score[ids], ids)
        bare = np.flatnonzero(~covered)
        for length in (1, 2, 3, 4) if len(bare) else ():
            who = rows[bare[char[bare] == length]]
            if len(who):
                _improve(best, came, piece, who, start, length, best[who, start] + unknown, np.full(len(who), -1))
    # All segments back from their ends, one piece at a time.
    row, to = np.arange(n), sizes.copy()
    found_row, found_to, found_id = [], [], []
    while len(row):
        start, own = came[row, to], piece[row, to]
        whole = own >= 0
        found_row.append(row[whole])
        found_to.append(to[whole])
        found_id.append(own[whole])
        if not whole.all():
            size = (to - start)[~whole]
            who, where = np.repeat(row[~whole], size), ranges(start[~whole], size)
            found_row.append(who)
            found_to.append(where + 1)
            found_id.append(vocabulary.byte_id[data[who, where]])
        row, to = row[start > 0], start[start > 0]
    row, to, ids = np.concatenate(found_row), np.concatenate(found_to), np.concatenate(found_id)
    order = np.argsort(row * (width + 5) + to)
    return ids[order].astype(np.int32), np.bincount(row, minlength=n)


def _improve(best, came, piece, rows, start, length, score, ids) -> None:
    to = start + length
    better = score > best[rows, to]
    rows = rows[better]
    best[rows, to], came[rows, to], piece[rows, to] = score[better], start, ids[better]


class PieceCoder:
    """Ids of texts and texts of ids; each distinct segment is split once.

    A segment is a run of spaces with what follows up to the next space. Where no piece has a space
    behind another character, as in vocabularies split by white space, the best split of a text is
    the best splits of its segments. A space is put before every text that is not empty and taken
    away again on decoding. The marker character itself, where a text has it, is written in bytes,
    so decoding returns every text unchanged.
    """

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        inner = [p for p in vocabulary.text if b" " in p.lstrip(b" ")]
        self.by_segment = not inner
        self._vocabulary, self._most = vocabulary, most
        self._forget()
        self._piece_bytes = np.frombuffer(b"".join(vocabulary.text), dtype=np.uint8)
        self._piece_size = np.array([len(p) for p in vocabulary.text], dtype=np.int64)
        self._piece_begin = np.cumsum(self._piece_size) - self._piece_size

    def _forget(self) -> None:
        self._place: dict[int, int] = {}
        self._ids, self._size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: Texts) -> list[np.ndarray]:
        lead = [b" " + t if (t := texts.text(i)) else t for i in range(len(texts))]
        data = np.frombuffer(b"".join(lead), dtype=np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in lead])]).astype(np.int64)
        if not len(data):
            return [np.zeros(0, np.int32)] * len(texts)
        cut = np.zeros(len(data) + 1, dtype=bool)
        if self.by_segment:
            space = data == 32
            cut[1:-1] = space[1:] & ~space[:-1]
        cut[offsets] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        key = span_hashes(byte_values()[data], start, end)
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        if len(self._place) > self._most:
            self._forget()
        keys = distinct.tolist()
        fresh = np.array([i for i, k in enumerate(keys) if k not in self._place], dtype=np.int64)
        ids, counts = viterbi(self._vocabulary, data, start[first[fresh]], end[first[fresh]])
        n = len(self._place)
        self._place.update(zip(distinct[fresh].tolist(), range(n, n + len(fresh))))
        self._ids = np.concatenate([self._ids, ids])
        self._size = np.concatenate([self._size, counts])
        place = np.fromiter(map(self._place.__getitem__, keys), dtype=np.int64, count=len(keys))[back]
        size = self._size[place]
        begin = (np.cumsum(self._size) - self._size)[place]
        until = np.concatenate([[0], np.cumsum(size)])
        return np.split(self._ids[ranges(begin, size)], until[np.searchsorted(start, offsets[1:-1])])

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the text; without ids, the empty text."""
        return self._piece_bytes[ranges(self._piece_begin[ids], self._piece_size[ids])].tobytes()[1:]


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>) per row; null and empty texts have no ids. Other columns are not read."""
    return _coded(docs, vocabulary, id_col, False)


def decode_pieces(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """(id, text) from (id, ids); a null list gives the empty text, bytes that form no character are replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    key = encoded.schema[id_col].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder(shared.value)
        for batch in batches:
            lists = [np.array(ids if ids is not None else [], dtype=np.int64) for ids in batch.column(1).to_pylist()]
            texts = [coder.decode(ids).decode(errors="replace") for ids in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(decode, f"`{id_col}` {key}, text string")


def piece_report(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """(id, n_ids, n_byte_ids, ids_crc32, decoded_sha256): digests of the ids and of the text that
    decoding these ids gives."""
    return _coded(docs, vocabulary, id_col, True)


def _coded(docs: DataFrame, vocabulary: Vocabulary, id_col: str, digest: bool) -> DataFrame:
    """One narrow pass. The vocabulary is broadcast: its size is fixed by the model."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    key = docs.schema[id_col].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        coder = PieceCoder(words)
        is_byte = np.zeros(len(words.score), dtype=bool)
        is_byte[words.byte_id] = True
        for batch in batches:
            for rows, texts in text_slices(batch):
                found = coder.encode(texts)
                if not digest:
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.int32()))], [id_col, "ids"])
                    continue
                columns = [
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([int(is_byte[f].sum()) for f in found], pa.int64()),
                    pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()),
                    pa.array([hashlib.sha256(coder.decode(f)).hexdigest() for f in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *columns], [id_col, "n_ids", "n_byte_ids", "ids_crc32", "decoded_sha256"]
                )

    columns = "n_ids long, n_byte_ids long, ids_crc32 long, decoded_sha256 string" if digest else "ids array<int>"
    return docs.select(id_col, "text").mapInArrow(code, f"`{id_col}` {key}, {columns}")
