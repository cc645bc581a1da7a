"""Model hooks that take lists: same answers as one text at a time, whatever fails beside it."""

import weakref

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import models as mo
from tickerloom.operators import scoring as sc
from tickerloom.plans import toymodels as toy

TEXTS = ["AB and ABCD", "", None, "ABC boom", "WXYZ and QRS names new", "plain", "market crash", "ABCDE"]


@pytest.fixture(scope="module")
def headlines(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, headline string").repartition(2)


def test_answers_isolate_the_text_at_fault():
    asked = []

    def model(batch):
        asked.append(len(batch))
        if "bad" in batch:
            raise RuntimeError
        return [t.upper() for t in batch]

    assert mo.answers(model, ["a", "b", "bad", "c", "d"], 4, "?") == ["A", "B", "?", "C", "D"]
    assert max(asked) == 4
    assert mo.answers(model, [], 4, "?") == []
    # Too few answers are no answers.
    assert mo.answers(lambda b: b[:1], ["a", "b", "c"], 3, "?") == ["a", "b", "c"]


@pytest.mark.parametrize("size", [1, 3, 100])
def test_lists_give_what_single_texts_give(headlines, size):
    def one(text):
        if "boom" in text:
            raise RuntimeError
        return toy.entities(text)

    def many(texts):
        assert len(texts) <= size and all(texts)
        return [one(t) for t in texts]

    single = {r.i: r.entities for r in mo.with_entities(headlines, one).collect()}
    listed = {r.i: r.entities for r in mo.with_entities(headlines, batch_fn=many, batch_size=size).collect()}
    assert single == listed and [e.text for e in listed[0]] == ["ABCD"] and listed[3] == []
    # Compared with the text as a whole: null and blank headlines, keywords, failures.
    def level(text):
        if "boom" in text:
            raise RuntimeError
        return toy.impact(text)

    by_one = {r.i: r.fallback_impact for r in mo.with_impact_fallback(headlines, level).collect()}
    by_list = mo.with_impact_fallback(headlines, batch_fn=lambda b: [level(t) for t in b], batch_size=size)
    assert {r.i: r.fallback_impact for r in by_list.collect()} == by_one
    assert by_one[3] == "unknown" and by_one[4] == "high" and by_one[6] is None


def test_scores_do_not_depend_on_the_batch_size(spark):
    rows = [(f"h{i}", "shares rise " * (i % 4) + "cut") for i in range(50)]
    df = spark.createDataFrame(rows, "article_hash string, headline string")
    columns = ("article_hash", "model_ix", "positive_prob", "negative_prob", "neutral_prob")
    whole = sc.score_texts(df, toy.MODELS).select(*columns)
    small = sc.score_texts(df, toy.MODELS, batch_size=7).select(*columns)
    assert sorted(whole.collect()) == sorted(small.collect()) and whole.count() == 150
    with pytest.raises(ValueError):
        sc.score_texts(df, toy.MODELS, batch_size=0)
    with pytest.raises(ValueError):
        mo.with_entities(df, toy.entities, batch_fn=toy.entities_of_all)


def test_leading_words(spark):
    texts = ["", "  ", "a", " a  b\tc\n", "a b c d e", "x" * 50_000 + " " + "y z " * 50_000, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(sc.leading_words(F.col("t"), 3)).collect()]
    assert got[:5] == ["", "  ", "a", " a  b\tc\n", "a b c"]
    assert got[5] == "x" * 50_000 + " y z" and got[6] is None
    assert df.select(sc.leading_words(F.col("t"), 512)).collect()[5][0].split() == texts[5].split()[:512]


def test_answers_of_few_texts_are_alive_at_once():
    alive = weakref.WeakSet()
    most = 0

    class Label(str):
        pass

    def model(texts):
        nonlocal most
        most = max(most, len(alive))
        told = [Label(t.upper()) for t in texts]
        alive.update(told)
        return told

    texts = pa.array([None if i % 3 == 0 else f"text {i}" for i in range(500)])
    got = mo.asked_in_batches(texts, texts.is_valid(), model, 8, failed="?", kind=pa.string())
    assert got.to_pylist() == [t and t.upper() for t in texts.to_pylist()]
    # Those of one call, and of the call before until its array stands.
    assert most <= 16
