import random

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import text as tx
from tickerloom.functions import vocab
from tickerloom.functions.fingerprint import simhash64, simhash_batch, simhash_value

EXAMPLES = [
    ("The market may possibly recover if conditions potentially improve", lambda r: r.hedge_score > 0.2),
    ("Apple beats Q3 earnings, stock up 5%", lambda r: r.hedge_score < 0.1),
    ("may might could would should possibly potentially likely unlikely uncertain estimates "
     "approximately about", lambda r: r.hedge_score == 1.0),
    ("", lambda r: r.hedge_score == 0 and not r.has_negation and not r.is_forward_looking
     and r.tickers == []),
    ("Company failed to meet revenue guidance", lambda r: r.has_negation),
    ("Strong earnings beat across all segments", lambda r: not r.has_negation),
    ("Revenue did not grow in Q3", lambda r: r.has_negation),
    ("Stock rose despite weak macro data", lambda r: r.has_negation),
    ("Management expects next quarter revenue to grow 15%", lambda r: r.is_forward_looking),
    ("Guidance raised for next fiscal year 2026", lambda r: r.is_forward_looking),
    ("Full-year earnings forecast revised upward", lambda r: r.is_forward_looking),
    ("Stock closed down 3% on heavy volume yesterday", lambda r: not r.is_forward_looking),
    ("We plan to project more", lambda r: not r.is_forward_looking),
    ("AAPL and MSFT both rallied after the Fed decision", lambda r: r.tickers == ["AAPL", "MSFT"]),
    ("The CEO said AI will transform the ETF market", lambda r: r.tickers == []),
    ("A rate hike is coming", lambda r: r.tickers == []),
    ("NVDA up as NVDA reports record NVDA revenue", lambda r: r.tickers == ["NVDA"]),
    ("ÉTAT and X_AAPL and AAPLÉ, but (KO)", lambda r: r.tickers == ["KO"]),
    ("NVDA GPU sales drive record revenue quarter", lambda r: "Technology" in r.sectors),
    ("JPM reported record investment banking revenue", lambda r: r.sectors == ["Financials"]),
    ("XOM profits surge on oil price spike", lambda r: r.sectors == ["Energy"]),
    ("ZZZZ Corp reports earnings", lambda r: r.sectors == []),
    ("JPM and AAPL and GS", lambda r: r.sectors == ["Financials", "Technology"]),
    ("Market crash feared as recession signals mount", lambda r: r.market_impact == "high"),
    ("Merger agreement announced between two major banks", lambda r: r.market_impact == "high"),
    ("Quarterly earnings report shows modest revenue growth", lambda r: r.market_impact == "medium"),
    ("Reporters gather", lambda r: r.market_impact == "medium"),
    ("Some minor operational update from a small company", lambda r: r.market_impact == "low"),
]


def featured(spark, rows):
    df = spark.createDataFrame(
        [(i, h, b) for i, (h, b) in enumerate(rows)], "id int, headline string, body string"
    ).withColumn("fallback", F.lit("low"))
    return tx.with_features(df, "fallback").orderBy("id").collect()


def test_examples(spark):
    found = featured(spark, [(h, "") for h, _ in EXAMPLES])
    wrong = [h for (h, check), row in zip(EXAMPLES, found) if not check(row)]
    assert wrong == []


def test_one_row_equals_many(spark):
    rows = [("Apple beats earnings", ""), ("Fed may raise rates", "not KO"), ("Oil crash fears", "")]
    many = featured(spark, rows)
    for i, row in enumerate(rows):
        single = featured(spark, [row])[0].asDict()
        assert single | {"id": i} == many[i].asDict()


def test_words_match_python(spark):
    rng = random.Random(1)
    alphabet = "ab.İß-" + vocab.WHITESPACE_CHARS
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    stripped = tx.full_text(F.col("t"), F.lit(""))
    got = df.select("t", stripped.alias("s"), tx.words(F.col("t")).alias("w")).collect()
    assert all(r.s == f"{r.t} ".strip() and r.w == r.t.lower().split() for r in got)


def test_hedge_and_negation_match_python(spark):
    rng = random.Random(2)
    pool = [*vocab.HEDGE_WORDS, *vocab.NEGATION_WORDS, "may,", "notable", "x", "however-but"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    normal = tx.normal_form(F.col("t"))
    got = df.select("t", tx.hedge_score(normal).alias("h"), tx.has_negation(normal).alias("n"))
    for r in got.collect():
        words = r.t.split()
        share = sum(w in vocab.HEDGE_WORDS for w in words) / len(words) if words else 0.0
        assert r.h == pytest.approx(share)
        assert r.n == any(w in vocab.NEGATION_WORDS for w in words)


def test_content_hash_and_unknown_impact(spark):
    import hashlib

    df = spark.createDataFrame([("h", "u"), ("h", "v"), ("hu", "")], "h string, u string")
    got = [r.x for r in df.select(tx.content_hash(F.col("h"), F.col("u")).alias("x")).collect()]
    assert got == [hashlib.sha256(t.encode()).hexdigest()[:16] for t in ("hu", "hv", "hu")]
    assert df.select(tx.market_impact(F.col("h")).alias("m")).first().m == "unknown"


def test_sector_dimension_drops_unknown(spark):
    df = spark.createDataFrame([("AAPL",), ("ZZZZ",), ("KO",)], "ticker string")
    got = {(r.ticker, r.sector) for r in tx.sector_dimension(df).collect()}
    assert got == {("AAPL", "Technology"), ("KO", "Consumer Staples")}


def test_fingerprint_batch_equals_single(spark):
    rng = random.Random(3)
    texts = ["", "a", "abc", "Aa Bb", "😀 wörter 𠀀 zwei", None] + [
        "".join(rng.choice("abcdé ,.") for _ in range(rng.randint(0, 200))) for _ in range(50)
    ]
    expected = [None if t is None else simhash_value(t) for t in texts]
    assert simhash_batch(texts) == expected
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", simhash64(F.col("t")).alias("fp")).orderBy("i").collect()
    assert [r.fp for r in got] == expected
