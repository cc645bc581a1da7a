"""What the text features compute once per row, and the same results by plain Python."""

from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.functions import vocab

TEXTS = [
    "", " ", " \t\n ", "may", "may may  not", "no nor\x1cnot", "Might it rain? NOT now", "could\xa0 would",
    "un likely about", "failed,", "a  b   c    may    d", "not-no", "x" * 50 + " never " + "y" * 50, "İ may",
]


def test_lower_case_is_built_once_and_no_word_list(spark):
    rows = spark.createDataFrame([(t, "") for t in TEXTS], "headline string, body string")
    plan = tx.with_features(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2
    assert "[^ ]+" not in plan


def test_features_by_plain_python(spark):
    rows = spark.createDataFrame([(t, "") for t in TEXTS], "t string, body string")
    normal = tx.normal_form(F.col("t"))
    got = rows.select("t", tx.hedge_score(normal).alias("h"), tx.has_negation(normal).alias("n")).collect()
    for r in got:
        words = r.t.lower().split()
        assert r.h == sum(w in vocab.HEDGE_WORDS for w in words) / max(len(words), 1), r
        assert r.n == any(w in vocab.NEGATION_WORDS for w in words), r
    none = spark.createDataFrame([(None,)], "t string").select(tx.hedge_score(normal), tx.has_negation(normal))
    assert none.collect() == [(None, None)]


def test_any_case_opens_a_forward_looking_word(spark):
    yes = ["ſhall", "PLANſ", "GUIDANCE", "full\xa0Year", "outlooK", "Next \t quarter", "fiscal 2024"]
    no = ["ſhalls", "xwill", "_plan", "éwill" + "x", "nextquarter", "fiscal 1924"]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = {r.t: r.f for r in rows.select("t", tx.is_forward_looking(F.col("t")).alias("f")).collect()}
    assert got == {**dict.fromkeys(yes, True), **dict.fromkeys(no, False)}
