"""Benchmark passages against brute force, and the numbers of long spans."""

import random
import re
from hashlib import sha256

import numpy as np
import pyarrow as pa

from tickerloom.llm import near_dedup, substring_dedup
from tickerloom.llm.decontaminate import LeakRules, longest_matches, remove_leaks, scan_leaks, suffix_array
from tickerloom.llm.words import span_hashes, text_slices, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item_id, passage in items:
            w = words(passage)
            n = min(window, len(w))
            for i in range(len(w) - n + 1) if n else ():
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == w[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add("" if item_id is None else str(item_id))
        spans = [(j, j + 1) for j in sorted(hit)]
        merged = []
        for a, b in spans:
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        out.append((doc_id, len(own), merged, sorted(found)))
    return sorted(out, key=repr)


def drawn(seed):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(["a", "b", "C", "é", "x1", "..", "A,b"]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 3, 40, 400]))) for i in range(40)]
    docs += [(7, docs[7][1]), (None, docs[8][1]), (50, None), (51, ""), (52, "b " * 3000), (53, "... !")]
    items = [(i, text(rng.choice([1, 2, 12, 30]))) for i in range(12)]
    items += [(3, "b b b b b b"), (3, "zz"), (None, "é x1 é"), (90, None), (91, "--"), (92, docs[9][1])]
    return docs, items


def got(frame):
    return sorted(
        [(r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["items"]) for r in frame.collect()],
        key=repr,
    )


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, spans int, items int").repartition(3),
        spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id int"),
    )


def test_leaks_by_brute_force(spark):
    for seed in range(2):
        docs, items = drawn(seed)
        left, right = frames(spark, docs, items)
        for rules in (
            LeakRules(window=4),
            LeakRules(window=4, shard_words=50, shard_bytes=300),
            LeakRules(window=4, block_bytes=150),
        ):
            assert got(scan_leaks(left, right, rules)) == brute(docs, items, 4)


def test_removal_keeps_columns_and_clean_rows(spark):
    docs, items = drawn(3)
    left, right = frames(spark, docs, items)
    clean = sorted((d for d, _, spans, _ in brute(docs, items, 6) if not spans), key=repr)
    for rules in (LeakRules(window=6), LeakRules(window=6, block_bytes=150)):
        kept = remove_leaks(left, right, rules)
        assert kept.columns == left.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == clean


def test_empty_tables(spark):
    left, right = frames(spark, [(1, "a b c")], [(1, "a b")])
    none = left.limit(0)
    assert scan_leaks(none, right).count() == 0 and longest_matches(none, right).count() == 0
    rows = got(scan_leaks(left, right.limit(0)))
    assert rows == [(1, 3, [], [])] and longest_matches(left, right.limit(0)).count() == 0
    assert remove_leaks(left, right.limit(0)).count() == 1 and remove_leaks(left, right).count() == 0


def test_longest_matches(spark):
    docs, items = drawn(5)
    docs = [d for d in docs if d[0] is not None]
    left, right = frames(spark, docs, items)
    want = {}
    for item_id, passage in items:
        w = words(passage)
        n = min(5, len(w))
        for i in range(len(w) - n + 1) if n else ():
            best = None
            for doc_id, text in docs:
                own = words(text)
                for j in range(len(own)):
                    k = 0
                    while i + k < len(w) and j + k < len(own) and w[i + k] == own[j + k]:
                        k += 1
                    if k >= n and (best is None or (-k, doc_id, j) < best):
                        best = (-k, doc_id, j)
            if best:
                key = ("" if item_id is None else str(item_id), i)
                best = (-best[0], best[1], best[2])
                if key not in want or (-best[0], *best[1:]) < (-want[key][0], *want[key][1:]):
                    want[key] = best
    for rules in (LeakRules(window=5), LeakRules(window=5, shard_words=60, shard_bytes=400)):
        rows = longest_matches(left, right, rules).collect()
        assert {(r["item_id"], r["item_start"]): (r["length"], r["doc_id"], r["doc_start"]) for r in rows} == want


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        values = rng.integers(0, 3, n).astype(np.uint64)
        for depth in (1, 4, n or 1):
            order = suffix_array(values, depth)
            assert sorted(order.tolist()) == list(range(n))
            texts = [values[i : i + depth].tolist() for i in order if values[i]]
            heads = [tuple(h[: h.index(0)] if 0 in h else h) for h in texts]
            assert heads == sorted(heads)


def thue_morse(n):
    return [bin(i).count("1") & 1 for i in range(n)]


def test_thue_morse_words_have_their_own_numbers():
    turn = thue_morse(4096)
    values = ["".join("ab"[t] for t in turn), "".join("ba"[t] for t in turn)]
    batch = pa.record_batch({"text": pa.array(values)})
    for _, texts in text_slices(batch):
        assert len(set(words_of(texts).hashes.tolist())) == 2
    for n in (64, 1024, 4096):
        both = np.array(turn[:n] + [1 - t for t in turn[:n]], dtype=np.uint64) * np.uint64(977)
        assert len(set(span_hashes(both, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2


def test_thue_morse_documents_are_told_apart(spark):
    turn = thue_morse(1024)
    texts = ["".join("ab"[t] for t in turn) + " tail", "".join("ba"[t] for t in turn) + " tail"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["kept"] for r in near_dedup.near_duplicates(docs).collect())
    blocks = [[f"w{k}x{i}" for i in range(24)] for k in range(1024)]
    whole = [" ".join(w for k, b in enumerate(blocks) for w in [*b, marks[turn[k]]]) for marks in ("pq", "qp")]
    docs = spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs).collect()}
    kept = " ".join("qp"[turn[k]] for k in range(1024))
    assert rows[0]["n_removed"] == 0
    assert (rows[1]["n_words"], rows[1]["n_removed"]) == (25_600, 24_576)
    assert rows[1]["kept_sha256"] == sha256(kept.encode()).hexdigest()
