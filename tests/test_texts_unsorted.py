"""Whole texts meet their predictions without being sorted."""

import re

from tickerloom.operators.results import assemble_results
from tickerloom.plans import views


def test_texts_stream_past_their_predictions(spark):
    docs = spark.createDataFrame(
        [(i, f"text {i} may crash", "web" if i % 2 else None) for i in range(50)] + [(3, "text 3 may crash", "web"), (60, None, "web")],
        "doc_id long, text string, source string",
    )
    articles = views.as_articles(docs)
    rows = views.enrich(articles)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=shuffle_hash)" in plan
    plan = rows._jdf.queryExecution().executedPlan().toString()
    found = plan.splitlines()
    at = next(i for i, line in enumerate(found) if re.search(r"\bShuffledHashJoin\b.*article_hash", line))
    text_side = next(line for line in found[at + 1 :] if re.search(r"\b(Sort|Exchange)\b", line))
    assert "Exchange" in text_side
    hashes = [r.article_hash for r in rows.select("article_hash").collect()]
    # A null source or text has no hash; equal rows both stay.
    assert len(hashes) == 26 and len(set(hashes)) == 25


def test_predictions_for_absent_articles_drop_out(spark):
    docs = spark.createDataFrame([(1, "one", "web"), (2, "two", "web")], "doc_id long, text string, source string")
    articles = views.as_articles(docs)
    predicted = views.predict(*views.scorer(articles.filter("headline LIKE '%one'")))
    assert [r.headline[-3:] for r in assemble_results(articles, predicted).collect()] == ["one"]
