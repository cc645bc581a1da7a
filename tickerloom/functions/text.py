"""Text features as column expressions; no function here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions import vocab

# A word boundary as Python sees it: Java's own \b counts combining marks as word characters.
_NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
_NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
_TICKER = r"(?=[A-Z])" + _NOT_AFTER_WORD + r"([A-Z]{1,5})" + _NOT_BEFORE_WORD
# The first letters are looked at first, as a plain class: the long s is one in any case.
_FORWARD = (
    r"(?=[EeFfGgNnOoPpSsWw\u017f])(?iu)" + _NOT_AFTER_WORD + "(?:"
    + vocab.FORWARD_LOOKING_TERMS.replace("{ws}", vocab.WHITESPACE_CLASS).replace(
        "{ws_in}", vocab.WHITESPACE_CLASS[1:-1]
    )
    + ")" + _NOT_BEFORE_WORD
)
# White space but for the space itself; the first class leaves out what is most common.
_OTHER_SPACE = "(?=[^ -~])[" + "".join(f"\\u{ord(c):04x}" for c in vocab.WHITESPACE_CHARS if c != " ") + "]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(vocab.WHITESPACE_CHARS))


def content_hash(headline: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(headline, url), 256), 1, 16)


def full_text(headline: Column, body: Column) -> Column:
    return strip(F.concat(headline, F.lit(" "), F.coalesce(body, F.lit(""))))


def normal_form(text: Column) -> Column:
    """Lower case, every white-space character a space, a space at both ends.

    Counting words and looking them up are then searches in one string; an array of words would be
    several times slower and leave generated code. Letters and spaces pass the pattern's first class at once.
    """
    plain = F.regexp_replace(F.lower(text), F.lit(_OTHER_SPACE), F.lit(" "))
    return F.concat(F.lit(" "), plain, F.lit(" "))


def words(text: Column) -> Column:
    """Lower-case words as an array; none for an empty text."""
    return F.filter(F.split(normal_form(text), " +"), lambda w: w != "")


def _one_of(terms: tuple[str, ...]) -> str:
    """A space and one of the words, by first letter. The space behind it is only looked at: it also opens the next word."""
    tails: dict[str, list[str]] = {}
    for term in terms:
        tails.setdefault(term[0], []).append(term[1:])
    branches = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in tails.items())
    return f" (?=[{''.join(tails)}])(?:{branches})(?= )"


def hedge_score(normal: Column) -> Column:
    """Share of hedging words among the words of a normal form; 0 where there are none.

    Words are counted by the single spaces around them: a pattern would list every word.
    """
    single = F.regexp_replace(normal, F.lit("  +"), F.lit(" "))
    total = F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "), F.lit(""))) - 1
    hedges = F.regexp_count(normal, F.lit(_one_of(vocab.HEDGE_WORDS)))
    return hedges / F.greatest(total, F.lit(1))


def has_negation(normal: Column) -> Column:
    return normal.rlike(_one_of(vocab.NEGATION_WORDS))


def is_forward_looking(text: Column) -> Column:
    return text.rlike(_FORWARD)


def extract_tickers(text: Column) -> Column:
    """Distinct capitals of length 2 to 5 in order of appearance, without the blocklist."""
    found = F.regexp_extract_all(text, F.lit(_TICKER), F.lit(1))
    allowed = F.filter(
        found, lambda t: (F.length(t) >= 2) & ~t.isin(*vocab.TICKER_BLOCKLIST)
    )
    return F.array_distinct(allowed)


def extract_sectors(tickers: Column) -> Column:
    pairs = [F.lit(v) for item in vocab.TICKER_SECTORS.items() for v in item]
    sectors = F.create_map(*pairs)
    found = F.transform(tickers, lambda t: F.try_element_at(sectors, t))
    return F.array_distinct(F.filter(found, lambda s: s.isNotNull()))


def _contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def keyword_impact(headline: Column) -> Column:
    """high, medium, or null where no keyword occurs."""
    return _impact_in(F.lower(headline))


def _impact_in(lowered: Column) -> Column:
    return F.when(_contains_any(lowered, vocab.HIGH_IMPACT), "high").when(
        _contains_any(lowered, vocab.MEDIUM_IMPACT), "medium"
    )


def market_impact(headline: Column, fallback: Column | None = None) -> Column:
    return _impact_or(keyword_impact(headline), fallback)


def _impact_or(found: Column, fallback: Column | None) -> Column:
    model = fallback if fallback is not None else F.lit(None).cast("string")
    return F.coalesce(found, model, F.lit("unknown"))


def with_features(articles: DataFrame, fallback_impact: str | None = None) -> DataFrame:
    """Add every text feature to (headline, body) rows. Row-local: one narrow stage.

    Three selects, so that the text, its normal form and the lower-case headline are each built once per row: a chain
    of "or" would build it again for every term.
    """
    fallback = F.col(fallback_impact) if fallback_impact else None
    kept = articles.columns
    with_text = articles.select("*", full_text(F.col("headline"), F.col("body")).alias("__text"))
    with_normal = with_text.select(
        "*",
        normal_form(F.col("__text")).alias("__normal"),
        F.lower("headline").alias("__lowered"),
        extract_tickers(F.col("__text")).alias("tickers"),
    )
    return with_normal.select(
        *kept,
        "tickers",
        extract_sectors(F.col("tickers")).alias("sectors"),
        is_forward_looking(F.col("__text")).alias("is_forward_looking"),
        has_negation(F.col("__normal")).alias("has_negation"),
        hedge_score(F.col("__normal")).alias("hedge_score"),
        _impact_or(_impact_in(F.col("__lowered")), fallback).alias("market_impact"),
    )


def sector_dimension(tickers: DataFrame, ticker: str = "ticker") -> DataFrame:
    """The dimension form of the lookup for one-ticker-per-row tables; unknown tickers drop out.

    The dimension is the fixed 31-row list, so broadcasting it is bounded.
    """
    dim = tickers.sparkSession.createDataFrame(
        list(vocab.TICKER_SECTORS.items()), f"{ticker} string, sector string"
    )
    return tickers.join(F.broadcast(dim), ticker)
