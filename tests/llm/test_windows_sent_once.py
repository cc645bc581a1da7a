"""Repeated windows are found by one exchange, whose files go with the job."""

import gc

from pyspark.sql import functions as F
from test_brief_shuffles import shuffle_files

from tickerloom.llm import substring_dedup as sd

PASSAGE = " ".join(f"p{i}" for i in range(40))
ROWS = [(i, f"a{i} b{i} {PASSAGE} c{i}" if i % 2 else f"lone{i} text{i}") for i in range(40)]


def test_windows_meet_in_one_exchange(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    starts = sd.repeated_starts(docs, "doc_id", sd.RepeatRules())
    plan = starts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    got = {(r["id"], r["start"]) for r in starts.collect()}
    assert got == {(i, s) for i, _ in ROWS if i % 2 and i > 1 for s in range(2, 23)}


def test_rows_that_repeat_an_id_are_no_repeats_of_each_other(spark):
    docs = spark.createDataFrame([(7, PASSAGE), (7, PASSAGE), (9, PASSAGE + " end")], "doc_id long, text string")
    starts = sd.repeated_starts(docs, "doc_id", sd.RepeatRules())
    assert {r["id"] for r in starts.collect()} == {9}


def test_shuffle_files_of_the_steps_go(spark):
    gc.collect()
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)
    kept = shuffle_files(spark)
    rows = sd.dedup_substrings(docs)
    for _ in range(100):
        if not shuffle_files(spark) - kept:
            break
        spark.range(1).count()
    assert not shuffle_files(spark) - kept
    assert rows.filter("n_removed > 0").agg(F.sum("n_removed")).first()[0] == 19 * 40
