"""Links at the least similarity between sets about as large as a sketch."""

from math import comb

import numpy as np
import pytest

from tickerloom.llm import near_dedup


def chance_below(least, union, common, drawn):
    """Chance that fewer than `least` of `drawn` values out of `union` are among the `common` ones."""
    ways = sum(comb(common, i) * comb(union - common, drawn - i) for i in range(max(0, drawn - union + common), least))
    return ways / comb(union, drawn)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_sketches_of_similar_sets_share_enough(percent):
    rules = near_dedup.NearRules(percent=percent)
    for n in range(1, 400):
        for union in range(n, 100 * n // percent + 1):
            common = -(-percent * union // 100)
            if common <= n:
                assert chance_below(rules.shared(n), union, common, min(union, rules.sketch)) < 1e-5, (n, union)


def test_contained_sets_and_copies_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for size in range(60, 83):
        for part in (64, 65, -(-80 * size // 100), size - 1, size):
            if part <= size:
                words = [f"w{x}" for x in rng.integers(0, 1 << 40, size + 1)]
                start = int(rng.integers(0, size - part + 1))
                texts += [words, words[start : start + part + 1]]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [set(zip(w, w[1:])) for w in texts]
    want = {}
    for i in range(0, len(sets), 2):
        a, b = sets[i], sets[i + 1]
        want |= {i: i, i + 1: i if 100 * len(a & b) >= 80 * len(a | b) else i + 1}
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
