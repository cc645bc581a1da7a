"""Phrases against brute force, and the sort against sorted()."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tickerloom.llm.phrases import PhraseRules, _score, mine_phrases, multikey_quicksort

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, rules):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = rules.unknown if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) < 2 or a < rules.least:
                continue
            longer = [b for q, b in f.items() if len(q) == 3 and b >= rules.least and p in (q[:2], q[1:])] if len(p) == 2 else []
            if any(100 * b >= rules.inside * a for b in longer):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows)[: rules.top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def drawn(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "x1", "\U0001f600", "a\x1cb", "q"]
    ends = [" ", "  ", "\t", ", ", ". ", "\n", "; ", " ! "]
    text = lambda n: "".join(rng.choice(words) + rng.choices(ends, [9, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(n))
    docs = [(rng.choice(["en", "en", "fr", None, "und"]), text(rng.choice([0, 1, 5, 60]))) for _ in range(60)]
    return [*docs, docs[0], docs[0], ("en", None), ("de", ""), ("de", " \n\t"), ("fr", "a a " * 4000), ("en", "x" * 300_000)]


def test_phrases_by_brute_force(spark):
    for seed, rules in enumerate(
        [
            PhraseRules(least=3),
            PhraseRules(least=4, slice_bytes=200, bucket_words=60, heavy=20),
            PhraseRules(least=2, slice_bytes=90, bucket_words=9, heavy=6, top=7, inside=80),
        ]
    ):
        docs = drawn(seed)
        frame = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], "lang string, text string, word int, w1 int, n int")
        rows = mine_phrases(frame.repartition(4), rules).collect()
        assert sorted(map(tuple, rows)) == brute(docs, rules)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "lang string, text string")
    assert mine_phrases(frame).count() == 0
    blank = spark.createDataFrame([(None, None), ("en", " ")], "lang string, text string")
    assert mine_phrases(blank).count() == 0


def test_scores_of_counts_beyond_64_bits(spark):
    values = [(10**14, 10**14 + 7, 3 * 10**14 + 1), (999_999_999_999_999,) * 3, (10, 10, 10), (3_037_000_500, 3_037_000_501, 3_037_000_502)]
    rows = spark.createDataFrame(values, "a long, l long, r long").select("a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r["s"] for r in rows.collect()] == [10**6 * a * a // (l * r) for a, l, r in values]


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    for n, most in ((0, 3), (1, 3), (7, 2), (500, 5), (500, 10_000)):
        keys = [rng.integers(0, most, n).astype(np.uint64) for _ in range(3)]
        weight = rng.integers(1, 4, n)
        order, parts = multikey_quicksort(keys, weight)
        assert [tuple(k[i] for k in keys) for i in order] == sorted(zip(*keys))
        for depth in (1, 2, 3):
            want = Counter()
            for i in range(n):
                want[tuple(k[i] for k in keys[:depth])] += weight[i]
            first, total = parts[depth - 1]
            got = {tuple(k[order[at]] for k in keys[:depth]): t for at, t in zip(first, total)}
            assert got == want and len(first) == len(want)
            for least in (2, 9):
                order2, parts2 = multikey_quicksort(keys, weight, least)
                first, total = parts2[depth - 1]
                got = {tuple(k[order2[at]] for k in keys[:depth]): t for at, t in zip(first, total)}
                assert got == {w: t for w, t in want.items() if t >= least}
