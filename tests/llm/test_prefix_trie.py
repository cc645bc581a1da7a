"""The prefix trie against brute force."""

import random
import re
from hashlib import sha256

from tickerloom.llm.prefix_trie import TrieRules, ordered_turns, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn int, role string, text string, rep long, low int, n int"


def sequences(rows):
    by_conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            by_conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in by_conv.items()}


def brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        leaf = lambda k: not any(len(q) == len(k) + 1 and q[: len(k)] == k for q in below)
        saved = sum((len(nodes[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(key))
        out.append(
            (
                min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
                sum(len(k) == len(key) + 1 for k in below), sum(leaf(k) for k in below), saved, sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def drawn(seed, most):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 5000), 60):
        n = rng.choice([1, 1, 2, 3, 5, most])
        turns = [(i, rng.choice(["user", "assistant"]), rng.choice(["yes yes", "no", "a b\tc", "é"])) for i in range(n)]
        rows += [(c, *t) for t in turns]
    one = [(0, "user", "the same"), (1, "assistant", "for all")]
    rows += [(c, *t) for c in range(6000, 6080) for t in one]
    rows += [(None, 0, "user", "nobody"), (7001, None, None, None), (7001, 0, "user", ""), (7002, None, "", "")]
    rows += [(7003, 3, "user", "twice")] * 3 + [(7004, 1, "b", "x"), (7004, 1, "a", "x"), (7005, 0, "user", "w " * 50_000)]
    rng.shuffle(rows)
    return rows


def got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_trie_by_brute_force(spark):
    for seed, most, rules in ((0, 4, TrieRules()), (1, 37, TrieRules(salts=3, chunk_bits=2))):
        rows = drawn(seed, most)
        frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)
        assert got(prefix_trie(ordered_turns(frame), frame, rules)) == brute(sequences(rows))


def test_conversations_without_turns(spark):
    frame = spark.createDataFrame([(5, 0, "user", "hi", 1, 1, 1)], SCHEMA)
    more = spark.createDataFrame([(3,), (5,), (9,), (None,)], "conv_id long")
    assert got(prefix_trie(ordered_turns(frame), more)) == brute({3: [], 5: [("user", "hi")], 9: []})
    none = frame.limit(0)
    assert got(prefix_trie(ordered_turns(none), more)) == brute({3: [], 5: [], 9: []})
    assert prefix_trie(ordered_turns(none), none).count() == 0


def test_places_of_a_conversation_that_lies_in_many_tasks(spark):
    rows = [(1, i, "user", str(i), 0, 0, 0) for i in range(3000)] + [(2, 0, "user", "x", 0, 0, 0), (0, 1, "user", "y", 0, 0, 0)]
    turns = ordered_turns(spark.createDataFrame(rows, SCHEMA).repartition(6))
    places = {(r["conv_id"], r["text"]): r["place"] for r in turns.collect()}
    assert places == {(1, str(i)): i + 1 for i in range(3000)} | {(2, "x"): 1, (0, "y"): 1}
