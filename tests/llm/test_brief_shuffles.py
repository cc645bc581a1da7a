"""What a chain of checkpoints leaves behind while it runs."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.llm import components as cc
from tickerloom.llm import near_dedup as nd
from tickerloom.llm.near_dedup import NearRules, near_duplicates
from tickerloom.session import brief_shuffles

SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    """Data files of shuffles that the session's own folders hold."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {p for d in manager.localDirs() for p in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}


def test_shuffle_files_go_with_their_job(spark):
    before, kept = spark.conf.get(SETTING, None), shuffle_files(spark)
    with brief_shuffles(spark):
        held = spark.range(10_000).groupBy((F.col("id") % 500).alias("k")).count().checkpoint()
        assert spark.conf.get(SETTING) == "true"
    assert spark.conf.get(SETTING, None) == before
    for _ in range(100):
        if not shuffle_files(spark) - kept:
            break
        spark.range(1).count()
    assert not shuffle_files(spark) - kept
    assert held.agg(F.sum("count")).first()[0] == 10_000


def test_setting_comes_back_after_an_error(spark):
    spark.conf.set(SETTING, "false")
    try:
        with brief_shuffles(spark):
            raise ValueError
    except ValueError:
        assert spark.conf.get(SETTING) == "false"
    finally:
        spark.conf.unset(SETTING)


def test_stars_need_no_round(spark, monkeypatch):
    """Found components as links, and none at all, are components at once."""
    rounds = []
    large = cc._large_star
    monkeypatch.setattr(cc, "_large_star", lambda edges: rounds.append(1) or large(edges))
    stars = spark.createDataFrame([(5, 1), (1, 7), (9, 8), (8, 8), (5, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in cc.components(stars).collect()}
    assert got == {1: 1, 5: 1, 7: 1, 8: 8, 9: 8}
    assert cc.components(stars.limit(0)).collect() == []
    assert not rounds
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in cc.components(path).collect()} == {0}
    assert rounds


def test_all_links_of_long_lists_by_brute_force(spark):
    """Groups around one common stem, so that lists are long and components found first grow afterwards."""
    rng = random.Random(3)
    stem = [f"s{i}" for i in range(80)]
    docs = []
    for _ in range(90):
        words = list(stem)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(40)}"
        docs.append(words)
    sets = [set(zip(w, w[1:])) for w in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = near_duplicates(table, rules=NearRules(short_list=4)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(root))


def test_texts_of_a_list_meet_once(spark):
    """Texts of other components around one stem share most of their leading values; each pair is made once."""
    docs = []
    for i in range(12):
        words = [f"s{k}" for k in range(120)]
        for k in range(3):
            words[10 * i + 3 * k] = f"x{i}-{k}"
        docs.append((i, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    chosen = spark.range(12).select(F.col("id").alias("rep"), F.col("id").alias("c"))
    asked = []
    linked = nd._linked_pairs

    def count(pairs, *more):
        asked.append(pairs)
        return linked(pairs, *more)

    crossed = []
    distinct = type(table).distinct

    def seen(frame):
        if frame.columns == ["a", "b"] and not asked:
            crossed.append(frame.count())
        return distinct(frame)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(nd, "_linked_pairs", count)
        patch.setattr(type(table), "distinct", seen)
        links = nd._linked_by_prefix(table, chosen, NearRules(), "doc_id")
    assert asked[0].count() == 66
    assert 66 <= crossed[0] <= 100
    assert links.count() == 66
