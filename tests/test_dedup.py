import random
from unittest.mock import patch

from pyspark.sql import functions as F

from tickerloom.functions.fingerprint import simhash_value
from tickerloom.operators import dedup as dd
from tickerloom.params import Params


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hamming(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def clustered(seed, clusters=6, each=25):
    """Random fingerprints with many neighbours a few bits away."""
    rng = random.Random(seed)
    out = []
    for _ in range(clusters):
        base = rng.getrandbits(64)
        for _ in range(each):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.append(signed(x))
    return out


def brute_pairs(values, distance=3):
    distinct = sorted(set(values))
    return {
        (a, b)
        for i, a in enumerate(distinct) for b in distinct[i + 1:] if hamming(a, b) <= distance
    }


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in set(values)], "fp long")


def test_pairs_equal_brute_force(spark):
    values = clustered(1)
    for hot in (10_000, 3):  # without and with the second level
        rows = dd.near_pairs(frame(spark, values), hot=hot).collect()
        got = [(r.fp_a, r.fp_b) for r in rows]
        assert len(got) == len(set(got))
        assert set(got) == brute_pairs(values)
        assert all(r.distance == hamming(r.fp_a, r.fp_b) for r in rows)


def test_pairs_between_two_tables(spark):
    values = clustered(2)
    left, right = values[::2], values[1::2]
    expected = {(a, b) for a in left for b in right if hamming(a, b) <= 3}
    for hot in (10_000, 3):
        rows = dd.near_pairs(frame(spark, left), frame(spark, right), hot=hot).collect()
        got = [(r.fp_a, r.fp_b) for r in rows]
        assert len(got) == len(set(got)) and set(got) == expected


def greedy(values):
    kept = []
    for i, v in enumerate(values):
        if all(hamming(v, values[k]) > 3 for k in kept):
            kept.append(i)
    return set(kept)


def test_greedy_thinning_equals_one_pass(spark):
    for seed in (3, 4):
        values = clustered(seed)
        random.Random(seed).shuffle(values)
        values += values[:40]
        df = spark.createDataFrame(list(enumerate(values)), "ordinal int, fp long")
        assert {r.ordinal for r in dd.thin(df).collect()} == greedy(values)


def test_chain_needs_many_rounds(spark):
    # Each fingerprint is two bits from the next: every other one survives.
    values, x = [], 0
    for i in range(0, 40, 2):
        values.append(x)
        x |= 3 << i
    df = spark.createDataFrame(list(enumerate(values)), "ordinal int, fp long")
    assert {r.ordinal for r in dd.thin(df).collect()} == greedy(values)


def test_exact_then_near_on_texts(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "stock", "rises", "falls", "bank"]
    texts = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)]
    texts += [t + "!" for t in texts[:5]] + texts[:5] + ["same"] * 60
    rows = [(i, t, t[:0] + str(hash(t))) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ordinal int, headline string, content_hash string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    order = sorted(first.values())
    keep = greedy([simhash_value(texts[i]) for i in order])
    assert {r.ordinal for r in dd.dedup(df, Params()).collect()} == {order[k] for k in keep}
    assert {r.ordinal for r in dd.dedup_exact(df).collect()} == set(order)


def test_exact_filter_runs_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "ordinal int, content_hash string")
    plan = dd.dedup_exact(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_drop_seen(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 2)], "content_hash string, fp long")
    seen = spark.createDataFrame([("a", 255)], "content_hash string, fp long")
    assert [r.content_hash for r in dd.drop_seen(batch, seen).collect()] == ["b"]
    near = spark.createDataFrame([("z", 3)], "content_hash string, fp long")
    far = spark.createDataFrame([("z", 1 << 40 | 0xFFF0)], "content_hash string, fp long")
    assert dd.drop_near_seen(batch, near).count() == 0
    assert dd.drop_near_seen(batch, far).count() == 2
    assert batch.select(F.max("fp")).first()[0] == 2


def test_banded_joins_send_no_table_through_the_driver(spark):
    prints = spark.range(500).select(F.xxhash64("id").alias("fp"))
    for found in (dd.near_pairs(prints), dd.near_pairs(prints, prints.limit(50))):
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_rounds_send_no_table_through_the_driver(spark):
    prints = F.array(*map(F.lit, sorted(set(clustered(3)))))
    firsts = spark.range(len(set(clustered(3)))).select(F.get(prints, F.col("id").cast("int")).alias("fp"), F.col("id").alias("ordinal"))
    places = []
    checkpoint = type(firsts).checkpoint

    def watched(df, *a, **b):
        places.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df, *a, **b)

    with patch.object(type(firsts), "checkpoint", watched):
        dd.dropped_fingerprints(firsts, Params(), "ordinal")
    assert len(places) >= 3 and not any("Broadcast" in p for p in places)
